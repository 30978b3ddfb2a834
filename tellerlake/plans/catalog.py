"""Every registered query: key -> (spark, folder of the star schema) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets, numeric, scores, text
from ..functions.segments import segment
from ..operators import (activity, cleaning, dashboard, evaluation, features, geography, insights,
                         kpis, lending, portfolio, risk, scoring, segmentation, stats, training)
from ..schema import (FEATURE_COLUMNS, FLAG_COLUMNS, IMPUTED_COLUMNS, KEY, NUMERIC_COLUMNS, ORDINAL,
                      TABLE_COLUMNS, TEXT_COLUMNS)
from ..sources import files, star, store
from . import models

Query = Callable[[SparkSession, str], DataFrame]


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.customers_of(spark, sf_dir)


def on_tables(operator, **params) -> Query:
    return lambda spark, d: operator(store.split_tables(bank(spark, d)), **params)


def on_bank(operator, *args, **params) -> Query:
    return lambda spark, d: operator(bank(spark, d), *args, **params)


CORPUS: dict[str, Query] = {
    "kpi_total_customers": on_tables(portfolio.total_customers),
    "kpi_avg_balance": on_tables(portfolio.avg_balance),
    "kpi_avg_income": on_tables(portfolio.avg_income),
    "kpi_total_deposits_crore": on_tables(portfolio.total_deposits),
    "kpi_default_rate": on_tables(portfolio.default_rate),
    "kpi_churn_rate": on_tables(portfolio.churn_rate),
    "kpi_avg_products": on_tables(portfolio.avg_products),
    "kpi_avg_credit_score": on_tables(portfolio.avg_credit_score),
    "kpi_complaint_rate": on_tables(portfolio.complaint_rate),
    "kpi_risk_distribution": on_tables(portfolio.risk_distribution),
    "kpi_active_inactive": on_tables(portfolio.active_inactive),
    "kpi_by_account_type": on_tables(portfolio.by_account_type),
    "kpi_by_age_group": on_tables(portfolio.by_age_group),
    "kpi_top10_balance": on_tables(portfolio.top_balances),
    "kpi_tenure_by_account_type": on_tables(portfolio.tenure_by_account_type),
    "seg_customer_detail": on_tables(segmentation.customer_segments),
    "seg_summary": on_tables(segmentation.segment_summary),
    "geo_customers_by_state": on_tables(geography.customers_by_state),
    "geo_risk_by_state": on_tables(geography.risk_mix_by_state),
    "geo_top_cities": on_tables(geography.top_cities),
    "geo_loan_performance": on_tables(geography.loan_performance),
    "geo_income_rank": on_tables(geography.income_rank),
    "loan_totals": on_tables(lending.loan_totals),
    "loan_status_breakdown": on_tables(lending.by_status),
    "loan_default_analysis": on_tables(lending.by_default),
    "loan_by_state": on_tables(lending.by_state),
    "loan_missed_distribution": on_tables(lending.missed_distribution),
    "loan_high_dti": on_tables(lending.strained_borrowers),
    "loan_tenure_analysis": on_tables(lending.by_tenure),
    "risk_distribution": on_tables(risk.distribution),
    "risk_high_customers": on_tables(risk.worst_payers),
    "risk_by_credit_category": on_tables(risk.by_credit_category),
    "risk_by_missed_bucket": on_tables(risk.by_missed_bucket),
    "risk_high_dti": on_tables(risk.high_ratio),
    "risk_by_state": on_tables(risk.by_state),
    "risk_default_correlation": on_tables(risk.defaults_by_label),
    "txn_totals": on_tables(activity.totals),
    "txn_top10": on_tables(activity.top_spenders),
    "txn_digital_adoption": on_tables(activity.digital_adoption),
    "txn_atm_distribution": on_tables(activity.atm_distribution),
    "txn_by_occupation": on_tables(activity.by_occupation),
    "txn_by_risk": on_tables(activity.by_risk),
}



def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored customer table as dirty text rows, repeated customers included."""
    return star.with_defects(bank(spark, sf_dir))


def per_customer(**columns: Column | Callable[[], Column]) -> Query:
    """Customer key and expressions, built when the query runs."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = bank(spark, sf_dir)
        return df.select(KEY, *[make().alias(name) for name, make in columns.items()])
    return run


def _minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income and age on a common scale; the extremes come from a scalar subquery."""
    df = bank(spark, sf_dir)
    ends = df.select(F.struct(F.min("Monthly_Income").alias("lo"),
                              F.max("Monthly_Income").alias("hi"))).scalar()
    return df.select(
        KEY, ((F.col("Monthly_Income") - ends["lo"]) / (ends["hi"] - ends["lo"] + 1))
        .alias("Income_Norm"), ((F.col("Age") - 18) / F.lit(57.0)).alias("Age_Norm"))


_c = F.col

DERIVED: dict[str, Query] = {
    "derive_credit_category": per_customer(
        Credit_Category=lambda: buckets.credit_category(_c("Credit_Score")),
        Credit_Category_Ranged=lambda: buckets.credit_category(_c("Credit_Score"), "ranged")),
    "derive_age_group": per_customer(
        Age_Group=lambda: buckets.age_group(_c("Age")),
        Age_Group_Between=lambda: buckets.age_group(_c("Age"), "between")),
    "derive_missed_bucket": per_customer(
        Missed_Between=lambda: buckets.missed_bucket(_c("Missed_Payments")),
        Missed_Upto=lambda: buckets.missed_bucket(_c("Missed_Payments"), "upto"),
        Missed_Cut=lambda: buckets.missed_bucket(_c("Missed_Payments"), "cut")),
    "derive_atm_bucket": per_customer(ATM_Bucket=lambda: buckets.atm_bucket(_c("ATM_Usage"))),
    "segment_sql_detail_rules": per_customer(Segment=lambda: segment("detail")),
    "segment_sql_summary_rules": per_customer(Segment=lambda: segment("summary")),
    "segment_app_rules": per_customer(Segment=lambda: segment("dashboard")),
    "format_inr": per_customer(
        unit=lambda: text.inr_unit(_c("Loan_Amount")),
        loan_text=lambda: text.format_inr(_c("Loan_Amount")),
        balance_text=lambda: text.format_inr(_c("Account_Balance")),
        income_text=lambda: text.format_inr(_c("Monthly_Income"))),
    "scale_crore": per_customer(
        Loan_Crore=lambda: numeric.crore(_c("Loan_Amount")),
        Balance_Crore=lambda: numeric.crore(_c("Account_Balance"))),
    "derive_loan_fields": per_customer(
        EMI=lambda: scores.instalment(_c("Loan_Amount"), _c("Loan_Tenure")),
        Average_Transaction_Value=lambda: scores.average_ticket(
            _c("Transaction_Amount"), _c("Transaction_Count")),
        Debt_to_Income_Ratio=lambda: scores.applicant_ratio(_c("EMI"), _c("Monthly_Income"))),
    "score_risk_rules": per_customer(
        Risk_Score=scores.risk_score, Rule_Label=scores.risk_label),
    "score_default_probability": per_customer(
        Default_Probability=lambda: scores.default_percent() / F.lit(100.0)),
    "score_churn_probability": per_customer(
        Churn_Probability=lambda: scores.churn_percent() / F.lit(100.0)),
    "minmax_income_age": _minmax,
    "risk_indicators": per_customer(
        Indicators=lambda: F.array_join(scores.risk_indicators(), ",")),
}


def cleaned(operator, *columns: str) -> Query:
    return lambda spark, d: operator(raw_rows(spark, d)).select(*columns or ["*"])


_IDS = [ORDINAL, KEY]

CLEANING: dict[str, Query] = {
    "clean_dedup": cleaned(cleaning.drop_repeats),
    "clean_coerce_numeric": cleaned(cleaning.coerce_numbers, *_IDS, *NUMERIC_COLUMNS[:]),
    "clean_coerce_binary": cleaned(cleaning.coerce_flags, *_IDS, *FLAG_COLUMNS),
    "clean_parse_date": cleaned(cleaning.parse_dates, *_IDS, "Last_Transaction_Date"),
    "clean_impute_median": cleaned(
        lambda raw: cleaning.impute_medians(store.cut(cleaning.typed(raw), "typed-customers")),
        KEY, *IMPUTED_COLUMNS),
    "clean_validate_ranges": cleaned(
        lambda raw: cleaning.keep_valid(cleaning.typed(raw)),
        KEY, "Age", "Credit_Score", "Monthly_Income", "Account_Balance", "Transaction_Amount"),
    "clean_fill_zero": cleaned(
        lambda raw: cleaning.fill_zero(cleaning.typed(raw)), KEY, *NUMERIC_COLUMNS),
    "clean_standardise_text": cleaned(cleaning.tidy_text, *_IDS, *TEXT_COLUMNS),
    "clean_recency": cleaned(
        lambda raw: cleaning.add_recency(cleaning.typed(raw)),
        KEY, "Last_Transaction_Date", "Days_Since_Transaction"),
    "clean_recompute_dti": cleaned(
        lambda raw: cleaning.recompute_ratio(cleaning.typed(raw)), KEY, "Debt_to_Income_Ratio"),
    "clean_label_domain": cleaned(cleaning.fix_labels, *_IDS, "Risk_Label"),
    "clean_stage_report": cleaned(cleaning.stage_report),
    "clean_customers": cleaned(cleaning.clean_customers),
    "profile_null_census": cleaned(lambda raw: cleaning.null_census(raw.drop(ORDINAL))),
}


PACKS: dict[str, Query] = {
    "kpi_pack": on_bank(kpis.kpi_pack),
    "kpi_executive": on_bank(kpis.executive),
    "kpi_transactions": on_bank(kpis.transactions),
    "kpi_loans": on_bank(kpis.loans),
    "kpi_risk": on_bank(kpis.risk),
    "kpi_eda_summary": on_bank(kpis.eda_summary),
}


def _filter_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bank(spark, sf_dir)
    states = [f"NATION_{i}" for i in range(1, 25)]
    return stats.select_customers(
        df, age=(25, 60), genders=["Male", "Female"], states=states,
        accounts=["Savings", "Current", "Salary"], score=(400, 850),
    ).select(KEY, "Age", "Gender", "State", "Account_Type", "Credit_Score")


STATISTICS: dict[str, Query] = {
    "value_counts": on_bank(stats.value_counts, "City"),
    "crosstab_long": on_bank(stats.crosstab_long, ["Gender", "Account_Type"]),
    "crosstab_wide": on_bank(stats.crosstab_wide, "Occupation", "Gender",
                             ["Female", "Male", "Other"]),
    "group_mean": on_bank(stats.group_mean, "Gender", "Customer_Satisfaction", scale=20.0,
                          name="Satisfaction_Pct", digits=9),
    "group_share": lambda spark, d: stats.group_share(
        bank(spark, d), ["State", "Gender"], _c("Complaints") > 2),
    "histogram": on_bank(stats.histogram, "Monthly_Expenses", 25),
    "five_number_summary": on_bank(stats.five_numbers, "Account_Type", "Account_Balance"),
    "describe_numeric": on_bank(stats.describe,
                                ["Account_Balance", "Loan_Amount", "Debt_to_Income_Ratio"]),
    "correlation_matrix": on_bank(stats.correlation_matrix,
                                  ["Age", "Monthly_Income", "Credit_Score", "Tenure_Years"]),
    "filter_customers": _filter_customers,
}


def on_page(operator, *args, **params) -> Query:
    """Over the customers the customer page shows at first."""
    return lambda spark, d: operator(dashboard.customer_page(bank(spark, d)), *args, **params)


def on_loans(operator, *args, **params) -> Query:
    return lambda spark, d: operator(dashboard.open_loans(bank(spark, d)), *args, **params)


PAGES: dict[str, Query] = {
    "exec_risk_counts": on_bank(stats.value_counts, "Risk_Label", name="Risk"),
    "exec_account_type_counts": on_bank(stats.value_counts, "Account_Type"),
    "exec_top_states": on_bank(stats.value_counts, "State", top=10),
    "exec_credit_score_hist": on_bank(dashboard.credit_score_histogram),
    "exec_state_risk": on_bank(stats.crosstab_long, ["State", "Risk_Label"]),
    "cust_filtered_count": on_bank(dashboard.filtered_count, age=(25, 60),
                                   genders=["Male", "Female"], score=(400, 850)),
    "cust_age_hist": on_page(stats.histogram, "Age", 30),
    "cust_gender_counts": on_page(dashboard.gender_shares),
    "cust_income_hist": on_page(stats.histogram, "Monthly_Income", 40),
    "cust_balance_hist": on_page(stats.histogram, "Account_Balance", 40),
    "cust_income_by_occupation": on_page(stats.group_mean, "Occupation", "Monthly_Income"),
    "cust_tenure_hist": on_page(stats.histogram, "Tenure_Years", 20),
    "cust_product_counts": on_page(stats.value_counts, "Number_of_Products", name="Products",
                                   order="key"),
    "cust_occupation_counts": on_bank(stats.value_counts, "Occupation"),
    "txn_amount_hist": on_bank(stats.histogram, "Transaction_Amount", 40),
    "txn_count_hist": on_bank(stats.histogram, "Transaction_Count", 30),
    "txn_channel_adoption": on_bank(dashboard.channel_adoption),
    "txn_atm_hist": on_bank(stats.histogram, "ATM_Usage", 20),
    "txn_amount_by_occupation": on_bank(dashboard.mean_with_text, "Occupation",
                                        "Transaction_Amount"),
    "txn_amount_by_risk": on_bank(dashboard.mean_with_text, "Risk_Label", "Transaction_Amount"),
    "txn_branch_hist": on_bank(stats.histogram, "Branch_Visits", 10),
    "loanpage_status_counts": on_loans(stats.value_counts, "Loan_Status", name="Status"),
    "loanpage_amount_hist": on_loans(stats.histogram, "Loan_Amount", 40),
    "loanpage_dti_hist": on_loans(stats.histogram, "Debt_to_Income_Ratio", 40),
    "loanpage_top_states": on_bank(dashboard.top_loan_states),
    "loanpage_missed_default": on_bank(dashboard.missed_default),
    "risk_age_group": on_bank(dashboard.age_risk),
    "risk_age_group_high": on_bank(dashboard.age_risk, "High"),
    "risk_credit_category_counts": on_bank(dashboard.credit_risk),
    "risk_missed_counts": on_bank(dashboard.missed_risk),
    "risk_dti_quartiles": on_bank(dashboard.ratio_spread),
    "risk_state_credit_heatmap": on_bank(dashboard.state_credit_heatmap),
    "risk_high_sample": on_bank(dashboard.high_risk_sample),
    "segpage_summary": on_bank(dashboard.segment_summary),
    "segpage_summary_formatted": on_bank(dashboard.segment_summary_text),
    "segpage_segment_risk": on_bank(dashboard.segment_risk),
    "eda_income_hist": on_bank(stats.histogram, "Monthly_Income", 50),
    "eda_balance_hist": on_bank(stats.histogram, "Account_Balance", 50),
    "eda_credit_counts": on_bank(dashboard.credit_counts),
    "eda_credit_risk_crosstab": on_bank(dashboard.credit_risk_wide),
    "eda_describe": on_bank(stats.describe),
    "eda_income_describe": on_bank(stats.describe_rupees, "Monthly_Income"),
    "eda_date_describe": on_bank(stats.describe_date, "Last_Transaction_Date"),
    "eda_correlation": on_bank(stats.correlation_matrix),
}

INSIGHTS: dict[str, Query] = {
    "insight_riskiest_segment": on_bank(insights.riskiest_segment),
    "insight_top_default_state": on_bank(insights.top_default_state),
    "insight_credit_vs_risk": on_bank(insights.contrast, "Credit Score & Risk"),
    "insight_dti_vs_risk": on_bank(insights.contrast, "Debt-to-Income Impact"),
    "insight_missed_vs_risk": on_bank(insights.contrast, "Missed Payments"),
    "insight_products_vs_churn": on_bank(insights.contrast, "Products & Churn"),
    "insight_top_account_type": on_bank(insights.top_account_type),
    "insight_digital_vs_risk": on_bank(insights.contrast, "Digital Banking & Risk"),
    "insight_default_by_state": on_bank(insights.default_by_state),
    "insight_churn_by_segment": on_bank(insights.churn_by_segment),
    "insights_all": on_bank(insights.all_findings),
    "recommendations": on_bank(insights.recommendations),
}


# -- files and tables ----------------------------------------------------------

def _scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "customers-csv")
    files.write_csv(bank(spark, sf_dir), path)
    return files.read_customers_csv(spark, path)


def _write_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and clean files as CSV; cleaning starts from the raw file and is read back."""
    raw_path, path = (store.new_path(spark, n) for n in ("raw-csv", "clean-csv"))
    files.write_csv(raw_rows(spark, sf_dir), raw_path)
    files.write_csv(cleaning.clean_customers(files.read_raw_csv(spark, raw_path, ordinal=True)),
                    path)
    return files.read_customers_csv(spark, path)


def _scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.build_tables(bank(spark, sf_dir), store.new_path(spark, "bank-tables"))
    return spark.sql("""
        SELECT c.Customer_ID, c.State, t.Transaction_Count, l.Loan_Status, r.Risk_Label
        FROM customers c
        JOIN transactions t USING (Customer_ID)
        JOIN loans l USING (Customer_ID)
        JOIN risk_analysis r USING (Customer_ID)""")


def _table(name: str) -> Query:
    return lambda spark, d: store.split_tables(bank(spark, d))[name]


FILES: dict[str, Query] = {
    "scan_customers_csv": _scan_csv,
    "write_clean": _write_clean,
    "scan_tables": _scan_tables,
    **{f"tbl_{name}": _table(name) for name in TABLE_COLUMNS},
}


# -- model inputs and evaluation -----------------------------------------------

def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.encoders(spark, sf_dir).transform(bank(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vector, taken apart again so that every element has its name."""
    inputs = features.feature_inputs(_encoded(spark, sf_dir))
    vectors = features.assembler(inputs.columns).transform(inputs.select(KEY, *FEATURE_COLUMNS))
    return vectors.select(KEY, vector_to_array("features").alias("v")).select(
        KEY, *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(FEATURE_COLUMNS)])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).select(KEY, features.target(_c("Risk_Label")).alias("label"))


def _train_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = features.stratified_split(_labelled(spark, sf_dir))
    return features.class_weights(split.where(~_c("is_test")))


_SCORES = ["s_low", "s_medium", "s_high"]


def _rule_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside a rule-based prediction: evaluation input that needs no model."""
    chance = scores.default_percent().cast("double")
    return bank(spark, sf_dir).select(
        features.target(_c("Risk_Label")).alias("label"), chance.alias("s_high"),
        (100 - chance).alias("s_low"), (50 - F.abs(chance - 14)).alias("s_medium"),
        buckets.first_match([(chance >= 25, 2), (chance >= 10, 1)], 0).alias("prediction"))


LEARNING: dict[str, Query] = {
    "encode_categories": lambda spark, d: _encoded(spark, d).select(
        KEY, "Gender_enc", "Occupation_enc", "Account_Type_enc"),
    "assemble_features": _features,
    "encode_target": _labelled,
    "class_counts": on_bank(features.class_counts),
    "stratified_split": lambda spark, d: features.stratified_split(_labelled(spark, d)),
    "class_weights": _train_weights,
    "eval_auc_ovr_weighted": lambda spark, d: evaluation.auc_weighted(
        _rule_scored(spark, d), "label", _SCORES),
    "eval_weighted_f1_precision_recall": lambda spark, d: evaluation.weighted_scores(
        _rule_scored(spark, d), "label", "prediction"),
    "eval_confusion_matrix": lambda spark, d: evaluation.confusion_matrix(
        _rule_scored(spark, d), "label", "prediction"),
    "eval_roc_curve": lambda spark, d: evaluation.roc_curve(
        _rule_scored(spark, d), "label", _SCORES),
    "applicant_inputs": on_bank(scoring.applicant_inputs),
    "score_explanations": on_bank(scoring.explanations),
}


# -- trained models --------------------------------------------------------------

def _predictions(kind: str, **params) -> Query:
    return lambda spark, d: models.tested(spark, d, kind, **params).select(
        KEY, "label", "prediction", "p_low", "p_medium", "p_high")


def _predict_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer scored from the rows of the stored best model."""
    return training.predict(models.loaded(spark, sf_dir), bank(spark, sf_dir), [KEY])


def _gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = training.logistic_gradient(models.fitted(spark, sf_dir, "logistic"), models.table(spark, sf_dir))
    return found.withColumn("gradient", F.round("gradient", 6) + 0.0)


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.comparison(spark, list(models.results(spark, sf_dir).values()))


def _importance(top: int | None = None) -> Query:
    """Importances of the best model; a model without any gives no rows."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = models.fitted(spark, sf_dir, models.best_kind(spark, sf_dir))
        return training.importances(best, spark, training.feature_names(models.table(spark, sf_dir)), top)
    return query


def _write_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison and importances, written as files and read back, one row a figure."""
    path = store.new_path(spark, "reports")
    files.write_report(_importance()(spark, sf_dir), f"{path}/feature_importance")
    files.write_report(_comparison(spark, sf_dir), f"{path}/model_metrics")
    importance = files.read_importance(spark, f"{path}/feature_importance").select(
        F.lit("feature_importance").alias("report"), _c("feature").alias("item"), F.lit("importance").alias("figure"),
        _c("importance").alias("value"))
    metrics = files.read_metrics(spark, f"{path}/model_metrics").unpivot(
        "Model", ["ROC_AUC", "F1_Weighted", "Precision", "Recall"], "figure", "value").select(
        F.lit("model_metrics").alias("report"), _c("Model").alias("item"), "figure", "value")
    return importance.unionByName(metrics)


def _scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "reports")
    files.write_report(_comparison(spark, sf_dir), f"{path}/model_metrics")
    return files.read_metrics(spark, f"{path}/model_metrics")


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the stored best tree model, with the names of their features."""
    loaded = models.loaded(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in loaded.model.names])
    rows = loaded.model.nodes
    return rows.select("tree", "node", F.get(names, _c("feature")).alias("feature"), "threshold",
                       *[c for c in rows.columns if c.startswith("n") and c[1:].isdigit()])


def _save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored folder says of the model, held against its rows."""
    path = models.saved(spark, sf_dir)
    rows = spark.read.parquet(f"{path}/model").agg(
        F.count(F.lit(1)).alias("nodes"), F.count("feature").alias("splits"),
        F.sum(F.when(_c("node") == 1, _c("n0") + _c("n1") + _c("n2"))).alias("sampled"))
    features_ = spark.read.parquet(f"{path}/features").groupBy("best_name").agg(F.count(F.lit(1)).alias("features"))
    head = spark.read.parquet(f"{path}/manifest").select("best_name", "kind", "trees", "depth", _c("rows").alias("nodes"))
    return head.join(features_, "best_name").join(rows, "nodes").select(
        "best_name", "kind", "trees", "depth", "features", "nodes", "splits", "sampled")


def _score_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_applicants(models.loaded(spark, sf_dir), bank(spark, sf_dir))


def _boosting_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean training loss before each round of boosting and behind the last."""
    losses = models.fitted(spark, sf_dir, "boosted").losses
    return spark.createDataFrame(list(enumerate(losses)), "round int, loss double")


TRAINED: dict[str, Query] = {
    "train_logistic": _predictions("logistic"),
    "logistic_gradient": _gradient,
    "train_decision_tree": _predictions("tree"),
    "train_random_forest": _predictions("forest"),
    "train_boosted_trees": _predictions("boosted"),
    "boosting_losses": _boosting_losses,
    "model_comparison": _comparison,
    "feature_importance": _importance(),
    "feature_importance_top20": _importance(20),
    "feature_importance_top10": _importance(10),
    "save_risk_model": _save,
    "load_risk_model": _load,
    "predict_risk": _predict_all,
    "score_applicants": _score_applicants,
    "write_reports": _write_reports,
    "scan_model_metrics": _scan_metrics,
}


def all_queries() -> dict[str, Query]:
    return {**CORPUS, **DERIVED, **CLEANING, **PACKS, **STATISTICS, **PAGES, **INSIGHTS,
            **FILES, **LEARNING, **TRAINED}
