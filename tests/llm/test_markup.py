"""Ordinary markup that must not lose an article."""

import time

import pytest

from tellerlake.llm import html_text

PROSE = "The cat is on the mat and it was in the house of the man that had been there for all of the day."


@pytest.mark.parametrize("start", [
    '<div class="content with-sidebar">', '<div id="page" class="has-banner">', '<div class="social-science">',
    '<section class="header-and-body">', '<div class="sidebar">', '<div class="promo"><article>'])
def test_names_do_not_lose_the_page(start):
    page = f"{start}<p>{PROSE}</p><p>{PROSE}</p></article></div></section>"
    assert html_text.main_text(page) == f"{PROSE}\n\n{PROSE}"
    assert html_text.main_text(f"<article>{page}</article>") == f"{PROSE}\n\n{PROSE}"


def test_listed_names_still_mark():
    for name in ("main-nav", "comment-list", "share-buttons", "related-posts", "ad-slot", "site-footer", "cookie_bar"):
        page = f"<div class=x><p>{PROSE}</p></div><div class='{name}'><p>{PROSE}</p></div>"
        assert html_text.main_text(page) == PROSE, name
    # more comments than article
    assert html_text.main_text(f"<p>{PROSE}</p><div id=comments>" + f"<p>{PROSE}</p>" * 9 + "</div>") == PROSE


def test_header_with_a_name_in_an_article():
    page = f"<article><header class='entry-header'><h1>Head</h1></header><p>{PROSE}</p></article>"
    assert html_text.main_text(page) == f"Head\n\n{PROSE}"


def test_teaser_cards_do_not_displace_the_body():
    body = f"<div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>"
    page = body + "<article><h2>A card</h2><p>Read this one next.</p></article>"
    assert html_text.main_text(page).startswith(f"{PROSE}\n\n{PROSE}\n\n{PROSE}")


@pytest.mark.parametrize("text", [
    "Вчера вечером на берегу реки собрались жители деревни, чтобы обсудить, как построить новый мост до зимы.",
    "昨日の夕方、村の人々は川のほとりに集まり、冬が来る前に新しい橋をどのように架けるかについて話し合った。",
    "اجتمع سكان القرية مساء أمس على ضفة النهر لمناقشة كيفية بناء جسر جديد قبل حلول فصل الشتاء القادم.",
    "Χθες το βράδυ οι κάτοικοι του χωριού μαζεύτηκαν στην όχθη του ποταμού για να συζητήσουν τη νέα γέφυρα.",
    "Wczoraj wieczorem mieszkańcy wsi zebrali się nad brzegiem rzeki, aby omówić budowę nowego mostu przed zimą."])
def test_languages_without_a_stop_list(text):
    menu = "".join(f"<li><a href=x>{w}</a></li>" for w in text.split())
    page = f"<ul>{menu}</ul><div><p>{text}</p><p>{text}</p></div><div class=sidebar><p>{text}</p></div>"
    assert html_text.main_text(page) == f"{text}\n\n{text}"


def test_a_paragraph_in_another_script():
    text = "Вчера вечером на берегу реки собрались жители деревни, чтобы обсудить, как построить новый мост до зимы."
    assert html_text.main_text(f"<p>{PROSE}</p><div>{text}</div><p>{PROSE}</p>") == f"{PROSE}\n\n{text}\n\n{PROSE}"


@pytest.mark.parametrize("broken", [
    "<a ", '<a "', "<a '>", '<div class="ad">', "<div>x</span>", "<script ", "<script", "<!x", "<!--", "<?", "<![CDATA[",
    "</p", '<a "" x\'>\'', "<p>", "<span class=ad>x", "&#1", "&", "<", ">", "<b>x", "a=", "<div class=ad>x</div>", "</div>"])
def test_broken_markup_takes_linear_time(broken):
    for start in ("", "<p>text", "<div>" * 5000, "<a "):
        begun = time.perf_counter()
        html_text.main_text(start + broken * (1_000_000 // len(broken)))
        assert time.perf_counter() - begun < 5  # quadratic work takes minutes


def test_odd_markup():
    assert html_text.main_text(f"<svg width=1 /><p>{PROSE}</p>") == PROSE
    assert html_text.main_text(f"<p>{PROSE}</p><script>x") == PROSE
    assert html_text.main_text(f'<p>{PROSE}</p><p title="x>{PROSE}</p>') == f"{PROSE}\n\n{PROSE}"
    assert html_text.main_text(f"<p>{PROSE}<!-- a > b --> {PROSE}</p>") == f"{PROSE} {PROSE}"
    assert html_text.main_text(f"<p>{PROSE}</p><p>&#{'9' * 10_000}; {PROSE}</p>").endswith(f"� {PROSE}")
    assert html_text.main_text(f"<p title='a > b'>{PROSE}</p>") == PROSE
