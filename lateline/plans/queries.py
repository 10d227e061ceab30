"""The registered queries: every operator over the whole star-schema tables.

Each takes (spark, sf_dir). Arrays are shown joined and timestamps as text, so
that any SQL engine can be asked for the same values.
"""

import uuid
from datetime import date

from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.numbers import iso_text
from lateline.functions.redaction import count_secrets, entity_spans, redact_secrets
from lateline.functions.sprint import PARTS, parse_sprint
from lateline.functions.text import is_issue_key, is_project_key, project_of
from lateline.operators import alerts, completeness, drift, flatten, incremental, quality, redaction, replies, reports, scoring
from lateline.operators import sentiment as sent
from lateline.operators.features import model_input, ticket_features
from lateline.operators.labels import delay_label
from lateline.operators.team import latest_sentiment, merge_sentiment, team_features
from lateline.plans import monitoring, risk_model
from lateline.plans.training import labelled_features, project_delay_summary
from lateline.schemas import TICKET
from lateline.session import prepare
from lateline.sources import star
from lateline.sources.catalog import register_table
from lateline.plans.ingestion import ingest_issue_pages, ingest_messages, ingest_tickets, read_rejects
from lateline.sources.lake import Lake, path_exists
from lateline.sources.pages import issue_page_places, read_issue_pages, read_message_pages, rejected_issue_pages
from lateline.sources.staging import brief_shuffles, new_path, settle
from lateline.streaming import quality as stream_quality
from lateline.streaming import sentiment as stream_sent
from lateline.streaming import silver as stream_silver_pages

DRIFT_CUT = "1999-01-01"
FIXED_IMPORTANCE = [("sprint_rollover_count", 0.5), ("days_in_status", 0.25), ("story_points", 0.125), ("is_overdue", 0.0625)]
QUALITY_RULES = {
    **fv.QUALITY_RULES,
    "issue_type": {"type": "categorical", "allowed_values": ["Bug", "Story", "Task", "Epic"], "completeness": 1.0},
    "resolution_date": {"type": "datetime", "completeness": 0.5},
    "sprint": {"type": "string"},
}
QUALITY_COLUMNS = ["project_key", "issue_key", "story_points", "status", "priority", "issue_type", "created", "resolution_date"]
PERIOD = "2001-11-24 to 2001-12-01"
CHUNK_BYTES = 2_000
PAGES_A_FILE = 100_000  # of one issue; some 70 MB of JSON
TRAINING_ROUNDS = 10

# ---- shared inputs ---------------------------------------------------------


def _features(spark, sf_dir):
    return ticket_features(star.tickets(spark, sf_dir), star.AS_OF)


def _series(spark, sf_dir, hours=24):
    return sent.sentiment_series(star.raw_messages(spark, sf_dir), hours)


def _all_features(spark, sf_dir):
    """Every model input: ticket, team and sentiment features."""
    merged = merge_sentiment(team_features(_features(spark, sf_dir)), _series(spark, sf_dir))
    return merged.withColumn("sentiment_velocity", F.floor(F.col("sentiment_velocity") * 1e4 + 0.5) / 1e4)


def _labelled(spark, sf_dir, with_sentiment=False):
    series = _series(spark, sf_dir) if with_sentiment else None
    return labelled_features(star.tickets(spark, sf_dir), star.AS_OF, series)


def _predictions(spark, sf_dir):
    """Features and sentiment scored by a fixed rule, so that any engine gets the same levels."""
    merged = merge_sentiment(_features(spark, sf_dir), _series(spark, sf_dir))
    return scoring.with_risk(merged, F.col("rule_score"))


def _scored_heads(spark, sf_dir):
    """Ticket heads and scores alone, where no feature is read."""
    return scoring.with_risk(star.ticket_heads(spark, sf_dir), F.col("rule_score"))


def _anomalies(spark, sf_dir):
    return sent.sentiment_anomalies(_series(spark, sf_dir))


def _as_text(df):
    """Timestamps as ISO text."""
    return df.select(
        *[iso_text(F.col(n)).alias(n) if kind == "timestamp" else F.col(n) for n, kind in df.dtypes]
    )


# ---- features --------------------------------------------------------------

FEATURE_COLUMNS = list(fv.MODEL_FEATURES[:16]) + ["comment_count", "current_sprint_name"]


def q_ticket_features(spark, sf_dir):
    return _features(spark, sf_dir).select("issue_key", *FEATURE_COLUMNS)


def q_team_features(spark, sf_dir):
    return team_features(_features(spark, sf_dir)).select("issue_key", "complexity_per_person", "team_wip", "assignee_load")


def q_merged_sentiment(spark, sf_dir):
    merged = merge_sentiment(star.ticket_heads(spark, sf_dir), _series(spark, sf_dir))
    velocity = F.floor(F.col("sentiment_velocity") * 1e4 + 0.5) / 1e4
    return merged.select("issue_key", "avg_sentiment", velocity.alias("sentiment_velocity"), "sentiment_anomaly")


def q_delay_label(spark, sf_dir):
    labelled = delay_label(_features(spark, sf_dir))
    return labelled.select("issue_key", "project_key", "is_delayed")


def q_delay_label_by_project(spark, sf_dir):
    labelled = delay_label(_features(spark, sf_dir), by_project=True)
    return labelled.select("issue_key", "project_key", "is_delayed")


def q_project_delay_summary(spark, sf_dir):
    return project_delay_summary(_labelled(spark, sf_dir))


def q_model_input(spark, sf_dir):
    return model_input(_all_features(spark, sf_dir), ["issue_key"])


# ---- sentiment -------------------------------------------------------------


def q_sentiment_score(spark, sf_dir):
    return star.scored_messages(spark, sf_dir).select(
        "event_id", "channel_id", "user_id", "text", "sentiment_score", "reply_count", "reaction_count", "datetime_utc"
    )


def q_conversation_sentiment(spark, sf_dir):
    turns = star.texts(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", sent.score_text(F.col("text")).alias("sentiment_score"))


def q_file_lexicon_sentiment(spark, sf_dir):
    """Turns scored by a lexicon of 11,000 terms read from a file: frequent words and pairs, their valence told by length."""
    turns = star.texts(spark, sf_dir, "conversations")
    path = new_path(spark, "lexicon")
    sent.write_lexicon(sent.frequent_terms(turns).withColumn("valence", F.length("term") % 5 - 2.5), path)
    score = sent.score_text(F.col("text"), sent.read_lexicon(spark, path))
    return turns.select("conv_id", "turn", "role", score.alias("sentiment_score"))


def q_sentiment_timeseries_day(spark, sf_dir):
    return _series(spark, sf_dir)


def q_sentiment_timeseries_hour(spark, sf_dir):
    return _series(spark, sf_dir, 1)


def q_sentiment_anomalies(spark, sf_dir):
    return sent.first_anomalies(_anomalies(spark, sf_dir))


def q_sentiment_anomalies_all(spark, sf_dir):
    """Hourly drops of each project, all of them."""
    return sent.sentiment_anomalies(_series(spark, sf_dir, 1))


def q_sentiment_anomalies_hourly(spark, sf_dir):
    series = sent.sentiment_series(star.raw_messages(spark, sf_dir), 1, keys=())
    return sent.sentiment_anomalies(series, keys=())


def q_sentiment_outlook(spark, sf_dir):
    outlook = sent.sentiment_outlook(_series(spark, sf_dir))
    return outlook.withColumn("recent_sentiment", F.floor(F.col("recent_sentiment") * 1e6 + 0.5) / 1e6)


def q_sentiment_velocity(spark, sf_dir):
    latest = latest_sentiment(_series(spark, sf_dir))
    return latest.withColumn("sentiment_velocity", F.floor(F.col("sentiment_velocity") * 1e4 + 0.5) / 1e4)


# ---- model -----------------------------------------------------------------


def _folded(spark, sf_dir):
    labelled = delay_label(_features(spark, sf_dir))
    return scoring.walk_forward(labelled.select("issue_key", "created", "is_delayed", "rule_score"))


def q_walk_forward_folds(spark, sf_dir):
    return _folded(spark, sf_dir).select("issue_key", "ordinal", "test_fold")


def q_fold_weights(spark, sf_dir):
    return scoring.positive_weights(_folded(spark, sf_dir))


def q_classification_metrics(spark, sf_dir):
    metrics = scoring.classification_metrics(_folded(spark, sf_dir), score="rule_score")
    names = ("recall", "precision", "f1", "positive_rate", "auc_roc")
    return metrics.withColumns({n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6 for n in names})


def q_risk_levels(spark, sf_dir):
    return _scored_heads(spark, sf_dir).select("issue_key", "risk_score", "risk_level")


_models = {}


def _model(spark, sf_dir):
    """Features and a model with the default rounds, fitted once per application and state of the inputs.

    Kept as files of its own under the shared folder, which are looked for before they are used.
    """
    orders = star.table(spark, sf_dir, "orders").inputFiles()
    state = spark.read.format("binaryFile").load(orders).agg(F.max("modificationTime"), F.sum("length")).first()
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _models or not path_exists(spark, _models[key]):
        path = new_path(spark, "model")
        features = _labelled(spark, sf_dir, with_sentiment=True)
        inputs = [n for n in fv.MODEL_FEATURES if n in features.columns]
        features.select("issue_key", "project_key", "is_delayed", *inputs).write.parquet(f"{path}/features")
        model = risk_model.fit_model(spark.read.parquet(f"{path}/features"))
        risk_model.save_model(spark, model, {"rounds": fv.BOOSTING_ROUNDS}, f"{path}/stored", "v1")
        _models[key] = path
    path = _models[key]
    return spark.read.parquet(f"{path}/features"), risk_model.load_model(spark, f"{path}/stored")[0]


def q_risk_model_scores(spark, sf_dir):
    """Every ticket scored by the stored model, with what must hold of a score."""
    features, model = _model(spark, sf_dir)
    score, level = F.col("risk_score"), F.col("risk_level")
    fits = level == F.when(score >= fv.RISK_HIGH, "High").when(score >= fv.RISK_MEDIUM, "Medium").otherwise("Low")
    scored = risk_model.score(features, model)
    return scored.select("issue_key", "project_key", "is_delayed", score.between(0, 1).alias("in_range"), fits.alias("level_fits"))


def q_feature_importance(spark, sf_dir):
    """What must hold of the importances: known features, positive shares that add up to one."""
    table = risk_model.importance_table(spark, _model(spark, sf_dir)[1])
    known, share = F.col("feature").isin(*fv.MODEL_FEATURES), F.col("importance")
    return table.agg(
        F.count_if(~known).alias("unknown"),
        F.count_if(share < 0).alias("negative"),
        (F.abs(F.sum(share) - 1) < 0.01).alias("adds_up"),
        (F.count_distinct("feature") == F.count("*")).alias("distinct"),
    )


def q_top_risk_factors(spark, sf_dir):
    """Per ticket, how many factors it lists and whether each carries the ticket's own value."""
    features, model = _model(spark, sf_dir)
    importance = risk_model.feature_importance(model)
    listed = scoring.top_factors(features, importance, ["issue_key"])
    # the factors listed are the same for every ticket; values of other features would meet none
    names = [name for name, _ in scoring.most_important(importance)]
    own = drift.long_form(features, ["issue_key"], names).withColumnRenamed("value", "own")
    joined = listed.join(own, ["issue_key", "feature"], "left")
    same = F.col("value") == F.coalesce("own", F.lit(0.0))
    return joined.groupBy("issue_key").agg(F.count("*").alias("factors"), F.bool_and(same).alias("own_values"))


def q_model_storage(spark, sf_dir):
    """Scores of a model before and after it is stored, per project."""
    features, model = _model(spark, sf_dir)
    path = new_path(spark, "stored")
    risk_model.save_model(spark, model, {"rounds": fv.BOOSTING_ROUNDS}, path, "v2")
    again, _ = risk_model.load_model(spark, path)
    both = risk_model.probability(risk_model.probability(features, model, "before"), again, "after")
    return both.groupBy("project_key").agg(F.count("*").alias("tickets"), F.count_if(F.col("before") != F.col("after")).alias("changed"))


def q_model_scores(spark, sf_dir):
    """Score and level of every ticket by the fitted model."""
    features, model = _model(spark, sf_dir)
    return risk_model.score(features, model).select("issue_key", "project_key", "is_delayed", "risk_score", "risk_level")


def q_model_importances(spark, sf_dir):
    """The features the fitted trees use, with their shares."""
    return risk_model.importance_table(spark, _model(spark, sf_dir)[1])


def q_model_factors(spark, sf_dir):
    """The factors behind each ticket's score, ranked."""
    features, model = _model(spark, sf_dir)
    return scoring.top_factors(features, risk_model.feature_importance(model), ["issue_key"])


def q_model_learns(spark, sf_dir):
    """Against a constant: delayed tickets score higher on average than others, and scores differ within a project."""
    scored = q_model_scores(spark, sf_dir)
    mean = [F.avg(F.when(F.col("is_delayed") == side, F.col("risk_score"))) for side in (1, 0)]
    levels = F.count_distinct("risk_score") > 1
    return scored.agg(F.count("*").alias("tickets"), (mean[0] > mean[1] + 0.05).alias("tells_apart"), levels.alias("differs"))


def q_training_run(spark, sf_dir):
    """A training job from silver to a stored model, with few rounds: metrics of each fold of the walk-forward validation."""
    lake = Lake(spark, new_path(spark, "lake"))
    tickets = star.tickets(spark, sf_dir).drop("order_key").withColumn("ingested_at", F.lit(star.AS_OF))
    lake.write_silver(tickets, "jira", star.AS_OF, run_id="run-1")
    risk_model.run_training(lake, None, as_of=star.AS_OF, version="v1", rounds=TRAINING_ROUNDS)
    _, metadata = risk_model.load_model(spark, lake.path("models", "risk_model"))
    found = [(int(fold["test_fold"]), name, float(v)) for fold in metadata["fold_metrics"] for name, v in fold.items() if name != "test_fold" and v is not None]
    return spark.createDataFrame(found, "test_fold int, metric string, value double")


def q_ranked_factors(spark, sf_dir):
    return scoring.top_factors(_features(spark, sf_dir), FIXED_IMPORTANCE, ["issue_key"])


# ---- quality and drift -----------------------------------------------------


def _quality(spark, sf_dir, keys=()):
    tickets = star.tickets(spark, sf_dir, None).select(*QUALITY_COLUMNS)
    return quality.quality_report(tickets, QUALITY_RULES, keys)


def _violations(df):
    return df.withColumn("invalid_values", F.array_join("invalid_values", ","))


def q_quality_metrics(spark, sf_dir):
    return _quality(spark, sf_dir).metrics


def q_quality_violations(spark, sf_dir):
    return _violations(_quality(spark, sf_dir).violations)


def q_quality_summary(spark, sf_dir):
    return _quality(spark, sf_dir).summary


def q_quality_by_project(spark, sf_dir):
    return _quality(spark, sf_dir, ["project_key"]).summary


def q_quality_violations_by_project(spark, sf_dir):
    return _violations(_quality(spark, sf_dir, ["project_key"]).violations)


def q_quality_alerts(spark, sf_dir):
    made = alerts.quality_alerts(_quality(spark, sf_dir, ["project_key"]), as_of=star.AS_OF)
    count = F.get_json_object("payload", "$.violations_count").cast("long")
    first = F.get_json_object("payload", "$.violations[0].column")
    return made.select("alert_type", "project_key", count.alias("violations"), first.alias("first_column"), "created_at")


def _profiles(spark, sf_dir):
    """Feature profiles of the tickets created before and from the cut on, in one pass."""
    period = F.when(F.col("created") < F.lit(DRIFT_CUT).cast("timestamp"), "baseline").otherwise("current")
    features = _all_features(spark, sf_dir).withColumn("period", period)
    return drift.feature_profile(features, ["period"])


def q_drift_profile(spark, sf_dir):
    names = ("mean", "std", "median", "p25", "p75")
    return _profiles(spark, sf_dir).withColumns({n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6 for n in names})


def _drift(spark, sf_dir):
    profiles = settle(_profiles(spark, sf_dir), "profiles")
    base = profiles.where("period = 'baseline'").drop("period")
    # a feature the current data lacks
    gone = base.where("feature = 'story_points'").withColumn("feature", F.lit("retired_feature"))
    return drift.drift_report(base.unionByName(gone), profiles.where("period = 'current'").drop("period"))


def q_drift_report(spark, sf_dir):
    names = ("baseline_mean", "current_mean")
    return _drift(spark, sf_dir).withColumns({n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6 for n in names})


def q_drift_summary(spark, sf_dir):
    summary = drift.drift_summary(_drift(spark, sf_dir))
    return summary.withColumn("drifted_features", F.array_join("drifted_features", ","))


def q_baseline_roundtrip(spark, sf_dir):
    """Baseline profiles stored under two versions; one of them read back."""
    lake = Lake(spark, new_path(spark, "lake"))
    profiles = settle(_profiles(spark, sf_dir), "profiles")
    lake.save_baseline(profiles.where("period = 'baseline'").drop("period"), "v1")
    lake.save_baseline(profiles.where("period = 'current'").drop("period"), "v2")
    lake.save_baseline(profiles.where("period = 'current'").drop("period"), "v2")
    names = ("mean", "std", "median", "p25", "p75")
    return lake.load_baseline("v2").withColumns({n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6 for n in names})


def q_drift_status(spark, sf_dir):
    """One project's gold features against the stored baseline of all, as the drift page shows it."""
    lake = Lake(spark, new_path(spark, "lake"))
    lake.write_gold(_all_features(spark, sf_dir).drop("order_key"), run_date=star.AS_OF)
    lake.save_baseline(drift.feature_profile(lake.read_gold()))
    report = monitoring.drift_status(lake, "BUILDING").report
    names = ("baseline_mean", "current_mean")
    return report.withColumns({n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6 for n in names})


def q_retrain_requests(spark, sf_dir):
    envelopes = star.alert_envelopes(star.texts(spark, sf_dir, "events"))
    return alerts.retrain_requests(envelopes, ["PROJ", "ALPHA"], "event_id")


# ---- redaction -------------------------------------------------------------


def q_secret_redaction(spark, sf_dir):
    documents = star.texts(spark, sf_dir)
    text = F.col("text")
    return documents.select("doc_id", redact_secrets(text).alias("redacted"), count_secrets(text).alias("secrets"))


def q_pii_entities(spark, sf_dir):
    documents = star.texts(spark, sf_dir)
    spans = documents.select("doc_id", F.explode(entity_spans(F.col("text"))).alias("s"))
    return spans.select(
        "doc_id", F.col("s.type").alias("entity_type"), F.col("s.begin").alias("begin_at"), F.col("s.end").alias("end_at")
    )


def q_page_entities(spark, sf_dir):
    pages = star.texts(spark, sf_dir, "pages")
    spans = pages.select("page_id", F.explode(entity_spans(F.col("html"))).alias("s"))
    return spans.groupBy("page_id", F.col("s.type").alias("entity_type")).agg(F.count("*").alias("entities"))


def _redacted_documents(spark, sf_dir):
    return redaction.redact_records(star.texts(spark, sf_dir), ["text"])


def q_document_redaction(spark, sf_dir):
    mark = "_pii_redaction"
    return _redacted_documents(spark, sf_dir).select(
        "doc_id",
        "text",
        F.col(f"{mark}.pii_detected").alias("pii_detected"),
        F.array_join(f"{mark}.entity_types_found", ",").alias("entity_types"),
        F.col(f"{mark}.secrets_found").alias("secrets_found"),
    )


def q_redaction_summary(spark, sf_dir):
    return redaction.redaction_counts(_redacted_documents(spark, sf_dir), ["lang"])


def q_span_redaction(spark, sf_dir):
    """Documents redacted by a table of spans found earlier."""
    documents = star.texts(spark, sf_dir).select("doc_id", "text")
    spans = documents.select("doc_id", F.inline(entity_spans(F.col("text"))))
    return redaction.apply_span_table(documents, spans, "doc_id")


def q_nested_span_redaction(spark, sf_dir):
    """Documents redacted by spans within and across others: entities, each with its surroundings once more."""
    documents = star.texts(spark, sf_dir).select("doc_id", "text")
    found = documents.select("doc_id", F.length("text").alias("size"), F.inline(entity_spans(F.col("text"))))
    wide = found.select(
        "doc_id", F.lit("CONTEXT").alias("type"), F.greatest(F.lit(0), F.col("begin") - 60).alias("begin"), F.least("size", F.col("end") + 25).alias("end")
    )
    return redaction.apply_span_table(documents, found.select("doc_id", "type", "begin", "end").unionByName(wide), "doc_id")


def q_planted_secrets(spark, sf_dir):
    """Documents with secrets made from their digests, one kind or all kinds each, redacted and counted."""
    documents = star.with_secrets(star.texts(spark, sf_dir))
    text, clean = F.col("text"), redact_secrets(F.col("text"))
    return documents.select("doc_id", clean.alias("redacted"), count_secrets(text).alias("secrets")).withColumn(
        "untouched", F.col("secrets") == 0
    )


def q_text_chunks(spark, sf_dir):
    documents = star.texts(spark, sf_dir)
    return redaction.chunk_documents(documents, CHUNK_BYTES, "doc_id")


# ---- read models -----------------------------------------------------------


def q_project_risk_summary(spark, sf_dir):
    return reports.project_risk(_scored_heads(spark, sf_dir))


def q_risk_table(spark, sf_dir):
    return reports.risk_table(_predictions(spark, sf_dir))


def q_radar_points(spark, sf_dir):
    return reports.radar_points(_predictions(spark, sf_dir))


def q_radar_axes(spark, sf_dir):
    axes = reports.radar_axes(reports.radar_points(_predictions(spark, sf_dir)))
    return axes.withColumn("x_max", F.floor(F.col("x_max") * 1e6 + 0.5) / 1e6)


def q_ticket_lookup(spark, sf_dir):
    """The ticket with the highest key, looked up by that key; its factors beside it."""
    row = star.ticket_heads(spark, sf_dir).agg(F.max("order_key").alias("n"), F.max_by("issue_key", "order_key").alias("key")).first()
    features = ticket_features(star.tickets(spark, sf_dir, order_key=row["n"]), star.AS_OF)
    found = reports.ticket_lookup(scoring.with_risk(features, F.col("rule_score")), row["key"])
    factors = scoring.top_factors(found, FIXED_IMPORTANCE, ["issue_key", "project_key", "risk_score", "risk_level"])
    return factors.withColumn("key_project", project_of(F.col("issue_key")))


def q_report_facts(spark, sf_dir):
    return reports.report_facts(_scored_heads(spark, sf_dir))


def q_high_risk_digest(spark, sf_dir):
    return reports.high_risk_digest(_predictions(spark, sf_dir))


def q_score_digest(spark, sf_dir):
    return reports.score_digest(_scored_heads(spark, sf_dir))


def q_sentiment_digest(spark, sf_dir):
    series = _series(spark, sf_dir)
    return reports.sentiment_digest(series, sent.sentiment_anomalies(series))


def q_report_context(spark, sf_dir):
    series = _series(spark, sf_dir)
    predictions = scoring.with_risk(_features(spark, sf_dir), F.col("rule_score"))
    return reports.report_context(predictions, series, sent.sentiment_anomalies(series), PERIOD)


def q_classification_prompts(spark, sf_dir):
    return reports.classification_prompts(star.tickets(spark, sf_dir, fv.PROMPT_DESCRIPTION_CHARS))


def q_explanation_prompts(spark, sf_dir):
    scored = scoring.with_risk(_features(spark, sf_dir), F.col("rule_score"))
    return reports.explanation_prompts(scored, FIXED_IMPORTANCE)


def q_anomaly_prompts(spark, sf_dir):
    return reports.anomaly_prompts(_anomalies(spark, sf_dir))


# ---- replies ---------------------------------------------------------------


def _parsed_replies(spark, sf_dir):
    return replies.parse_replies(star.replies(star.texts(spark, sf_dir, "events")))


def q_reply_parse(spark, sf_dir):
    return _parsed_replies(spark, sf_dir).select(
        "event_id",
        F.try_variant_get("parsed", "$.hypothesis", "string").alias("hypothesis"),
        F.try_variant_get("parsed", "$.severity", "string").alias("severity"),
        "parse_error",
        F.when(F.col("parse_error"), F.col("raw")).alias("raw_response"),
    )


def q_cited_tickets(spark, sf_dir):
    return replies.cited_tickets(_parsed_replies(spark, sf_dir), "event_id")


def q_anomaly_analysis(spark, sf_dir):
    """Hourly anomalies joined to the replies about some of them."""
    series = _series(spark, sf_dir, 1)
    found = sent.sentiment_anomalies(series)
    body = F.concat(F.lit('{"hypothesis":"'), F.col("message_count").cast("string"), F.lit(' messages","severity":"low"}'))
    answered = series.where(F.col("message_count") % 2 == 1).select("project_key", "window_start", body.alias("raw"))
    analysed = replies.anomaly_analysis(found, answered)
    return analysed.select("project_key", "window_start", "z_score", "anomaly_rank", "analysis")


# ---- flattening ------------------------------------------------------------


def q_sprint_parse(spark, sf_dir):
    entries = star.sprint_texts(star.texts(spark, sf_dir, "lineitem"))
    readable = entries.where(F.col("entry").contains("["))
    parsed = readable.withColumn("s", parse_sprint(F.col("entry")))
    return parsed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f"s.{name}" for name in PARTS])


def _landed(pages):
    """Pages as files in a folder, as a crawler leaves them."""
    path = new_path(pages.sparkSession, "pages")
    _land(pages, path, PAGES_A_FILE)
    return path


def _land(pages, path, pages_a_file, *folders):
    """Compressed, in files short enough to be read side by side."""
    writer = pages.write.partitionBy(*folders) if folders else pages.write
    with brief_shuffles(pages.sparkSession):
        writer.option("compression", "gzip").option("maxRecordsPerFile", pages_a_file).text(path)


def _flat_issues(spark, sf_dir):
    path = _landed(star.raw_issue_pages(spark, sf_dir))
    return read_issue_pages(spark, path, star.POINTS_FIELD, star.SPRINT_FIELD, star.AS_OF)


def q_issue_flatten(spark, sf_dir):
    def shown(column, parts):
        return F.array_join(F.transform(column, lambda s: F.concat_ws("|", *[F.coalesce(s[p], F.lit("-")) for p in parts])), ";")

    return _flat_issues(spark, sf_dir).withColumns(
        {
            "labels": F.array_join("labels", ","),
            "components": F.array_join("components", ","),
            "sprint_history": shown("sprint_history", PARTS),
            "issue_links": shown("issue_links", ("type", "direction", "linked_issue")),
        }
    )


def q_message_flatten(spark, sf_dir):
    path = _landed(star.raw_message_pages(spark, sf_dir))
    return read_message_pages(spark, path, ingested_at=star.AS_OF).drop("thread_ts")


def q_page_rejects(spark, sf_dir):
    """Landed pages, some of them cut short: those read, and those kept as rejects."""
    pages = star.raw_issue_pages(spark, sf_dir)
    cut = F.get_json_object("value", "$.issues[0].id").cast("long") % 50 == 7
    half = F.substr("value", F.lit(1), F.floor(F.length("value") / 2).cast("int"))
    path = _landed(pages.select(F.when(cut, half).otherwise(F.col("value")).alias("value")))
    read = read_issue_pages(spark, path, star.POINTS_FIELD, star.SPRINT_FIELD, star.AS_OF).select("issue_id", F.lit("read").alias("outcome"))
    lost = rejected_issue_pages(spark, path, star.POINTS_FIELD, star.SPRINT_FIELD)
    number_of = F.regexp_extract("raw", r'"id":"(\d+)"', 1)
    return read.unionByName(lost.select(number_of.alias("issue_id"), F.lit("rejected").alias("outcome")))


def q_split_keys(spark, sf_dir):
    """Rows parted by the format of their key."""
    keys = q_key_validation(spark, sf_dir)
    valid, invalid = flatten.split_by_key(keys.select("o_orderkey", "issue_key"), "issue_key", "issue")
    return valid.withColumn("valid", F.lit(True)).unionByName(invalid.withColumn("valid", F.lit(False)))


def q_nested_json(spark, sf_dir):
    """Nested columns written as JSON text."""
    text = flatten.nested_to_json(_flat_issues(spark, sf_dir))
    return text.select("issue_key", "labels", "components", "issue_links")


def q_key_validation(spark, sf_dir):
    """Project and issue keys, well formed and not, with the verdict on each."""
    orders = star.texts(spark, sf_dir, "orders")
    customers = star.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    key, segment = F.col("o_orderkey"), F.col("c_mktsegment")
    project = F.when(key % 5 == 0, F.lower(segment)).when(key % 5 == 1, F.concat(segment, F.lit("-1"))).otherwise(segment)
    issue = F.when(key % 3 == 0, F.concat(segment, F.lit("-"))).otherwise(F.concat_ws("-", segment, (key * 1003).cast("string")))
    keys = joined.select("o_orderkey", project.alias("project_key"), issue.alias("issue_key"))
    return keys.select(
        "*",
        is_project_key(F.col("project_key")).alias("project_ok"),
        is_issue_key(F.col("issue_key")).alias("issue_ok"),
        project_of(F.col("issue_key")).alias("project"),
    )


def q_export_clean(spark, sf_dir):
    """Predictions with NaN, infinity, private columns and timestamps made fit for export."""
    heads = _scored_heads(spark, sf_dir)
    number_of = F.col("order_key")
    odd = F.when(number_of % 4 == 0, float("nan")).when(number_of % 4 == 1, float("inf")).otherwise(number_of / 7)
    rows = heads.select("issue_key", "created", "due_date", odd.alias("odd"), "risk_score", F.lit(1).alias("_private"))
    return flatten.export_clean(rows)


# ---- loads and lake --------------------------------------------------------


def _versions(spark, sf_dir):
    """Tickets ingested one to four times, each time updated a day later."""
    heads = star.ticket_heads(spark, sf_dir)
    version = F.explode(F.sequence(F.lit(0), (F.col("order_key") % 4).cast("int"))).alias("version")
    versions = heads.select("issue_key", "project_key", "status", "updated", version)
    later = F.col("updated") + F.make_interval(days=F.col("version"))
    return versions.withColumns({"updated": later, "ingested_at": F.concat(F.lit("run-"), F.col("version"))})


def q_latest_tickets(spark, sf_dir):
    return _as_text(incremental.latest(_versions(spark, sf_dir)))


def _state(spark, sf_dir):
    """Marks of all projects but one, as an earlier load would have left them."""
    heads = star.ticket_heads(spark, sf_dir).where("project_key <> 'MACHINERY'")
    mark = F.date_format(F.max("created"), "yyyy-MM-dd HH:mm").alias("last_ingest_date")
    return heads.groupBy("project_key").agg(mark)


def q_incremental_tickets(spark, sf_dir):
    heads = star.ticket_heads(spark, sf_dir).select("issue_key", "project_key", "updated")
    return _as_text(incremental.since_mark(heads, _state(spark, sf_dir)))


def q_advanced_marks(spark, sf_dir):
    batch = star.ticket_heads(spark, sf_dir).where("project_key not in ('BUILDING', 'FURNITURE')")
    return incremental.advance_marks(_state(spark, sf_dir), batch)


def q_recent_messages(spark, sf_dir):
    messages = star.raw_messages(spark, sf_dir)
    recent = incremental.recent_messages(messages, 24 * 7, star.MESSAGES_AS_OF)
    return recent.select("event_id", "channel_id", "datetime_utc")


def q_ingestion_summary(spark, sf_dir):
    clean = settle(redaction.redact_records(_flat_issues(spark, sf_dir), fv.TICKET_TEXT_FIELDS), "clean")
    report = quality.quality_report(clean, None, ["project_key"])
    asked = spark.createDataFrame([(name,) for name in ("BUILDING", "IDLE")], "project_key string")
    errors = spark.createDataFrame([("BROKEN", "unreadable page")], "project_key string, error string")
    return incremental.ingestion_summary(clean, report.summary, asked=asked, errors=errors)


def q_lake_roundtrip(spark, sf_dir):
    """Tickets through bronze, silver and gold: all read back, and marked where a filtered read has them too."""
    lake = Lake(spark, new_path(spark, "lake"))
    heads = settle(star.ticket_heads(spark, sf_dir).select("issue_key", "project_key", "status", "rule_score"), "heads")
    lake.write_bronze(heads, "jira", "2024-01-01")
    raw = lake.read_bronze("jira", heads.schema)
    lake.write_silver(raw.drop("project", "date"), "jira", "2024-01-02")
    lake.write_silver(raw.where("status = 'Done'").drop("project", "date"), "jira", "2024-01-03")
    part = lake.read_silver("jira", ["BUILDING", "MACHINERY"], "2024-01-02", heads.schema)
    part = part.select("issue_key", F.to_date("date").cast("string").alias("date"), F.lit(True).alias("filtered"))
    silver = lake.read_silver("jira", schema=heads.schema).withColumn("date", F.to_date("date").cast("string"))
    marked = silver.join(part, ["issue_key", "date"], "left").withColumnRenamed("date", "silver_date")
    lake.write_gold(marked.drop("project"), run_date="2024-01-04")
    return lake.read_gold().withColumn("date", F.col("date").cast("string"))


def q_newest_silver(spark, sf_dir):
    """Tickets ingested several times, one version each read back."""
    lake = Lake(spark, new_path(spark, "lake"))
    lake.write_silver(_as_text(_versions(spark, sf_dir)), "jira", "2024-01-02")
    return lake.read_silver("jira", newest_only=True).select("issue_key", "updated", "version")


class _Unfinished(Lake):
    """A lake whose marks do not move, as after a run that ended too early."""

    def save_state(self, state):
        pass


def q_repeated_load(spark, sf_dir):
    """A load that ended before its marks moved, run again under its id: each ticket is stored once."""
    root, tickets = new_path(spark, "lake"), _flat_issues(spark, sf_dir)
    for lake in (_Unfinished(spark, root), Lake(spark, root)):
        ingest_tickets(lake, tickets, star.AS_OF, run_id="run-1")
    stored = lake.read_silver("jira").groupBy("project_key").agg(F.count("*").alias("tickets"))
    alerted = lake.read_alerts().groupBy("project_key").agg(F.count("*").alias("alerts"))
    return stored.join(alerted, "project_key", "left").select("project_key", "tickets", F.coalesce("alerts", F.lit(0)).alias("alerts"))


def _landed_sets(spark, sf_dir):
    path = new_path(spark, "pages")
    _land(star.issue_page_sets(spark, sf_dir), path, PAGES_A_FILE // star.PAGE_SIZE, "project")
    return path


def _page_places(spark, sf_dir):
    return settle(issue_page_places(spark, _landed_sets(spark, sf_dir), star.POINTS_FIELD, star.SPRINT_FIELD), "places")


def q_page_sets(spark, sf_dir):
    """Landed page sets with pages lost, cut short and landed twice, held against the totals they declare."""
    return completeness.page_sets(_page_places(spark, sf_dir), 64).drop("page_set")


def q_page_gaps(spark, sf_dir):
    """The positions that no readable page covers."""
    return completeness.page_gaps(_page_places(spark, sf_dir), 64).drop("page_set")


def q_page_load(spark, sf_dir):
    """Landed page sets loaded: outcomes, what is stored, rejects, and whose marks moved."""
    lake = Lake(spark, new_path(spark, "lake"))
    path = _landed_sets(spark, sf_dir)
    summary, _ = ingest_issue_pages(lake, path, star.POINTS_FIELD, star.SPRINT_FIELD, star.AS_OF, run_id="run-1")
    rejects = read_rejects(lake).groupBy("project_key").agg(F.count("*").alias("rejects"))
    marks = lake.load_state().select("project_key", F.lit(True).alias("marked"))
    joined = summary.join(rejects, "project_key", "left").join(marks, "project_key", "left")
    return joined.select("project_key", "status", "tickets_ingested", F.coalesce("rejects", F.lit(0)).alias("rejects"), F.coalesce("marked", F.lit(False)).alias("marked"))


def q_united_schemas(spark, sf_dir):
    """Gold written in three schemas: with a narrower number, a column more, a column less; read as one table."""
    lake = Lake(spark, new_path(spark, "lake"))
    heads = settle(star.ticket_heads(spark, sf_dir).select("issue_key", "project_key", "order_key", "status"), "heads")
    small = heads.where("order_key % 3 = 0").select("issue_key", "project_key", F.col("order_key").cast("int").alias("size"))
    more = heads.where("order_key % 3 = 1").select("issue_key", "project_key", (F.col("order_key") + (1 << 33)).alias("size"), "status")
    less = heads.where("order_key % 3 = 2").select("issue_key", "project_key")
    for day, part in enumerate((small, more, less), 1):
        lake.write_gold(part, run_date=f"2024-01-0{day}")
    return lake.read_gold().select("issue_key", "size", "status", F.col("date").cast("string").alias("date"))


def q_repeated_gold(spark, sf_dir):
    """Gold of one run written twice, then of a later run for some projects: one run of each project is read."""
    lake = Lake(spark, new_path(spark, "lake"))
    heads = settle(star.ticket_heads(spark, sf_dir).select("issue_key", "project_key", "order_key"), "heads")
    for _ in range(2):
        lake.write_gold(heads.withColumn("run_of", F.lit("first")), run_date="2024-01-01", run_id="run-1")
    later = heads.where("project_key in ('BUILDING', 'MACHINERY') and order_key % 2 = 0")
    lake.write_gold(later.withColumn("run_of", F.lit("second")), run_date="2024-01-01", run_id="run-2")
    return lake.read_gold().select("issue_key", "run_of")


def q_merged_marks(spark, sf_dir):
    """Two loads of different projects that start from the same marks and end in either order."""
    lake = Lake(spark, new_path(spark, "lake"))
    lake.save_state(_state(spark, sf_dir))
    before = settle(lake.load_state(), "before")
    heads = star.ticket_heads(spark, sf_dir)
    for project in ("MACHINERY", "BUILDING"):
        lake.save_state(incremental.advance_marks(before, heads.where(F.col("project_key") == project)))
    return lake.load_state()


def q_message_load(spark, sf_dir):
    """Messages loaded twice under one run id and once more under a later one: silver of two runs, series of one."""
    lake = Lake(spark, new_path(spark, "lake"))
    messages = settle(q_message_flatten(spark, sf_dir).withColumn("project_key", F.upper("channel_id")), "messages")
    for run_id in ("run-1", "run-1", "run-2"):
        ingest_messages(lake, messages, star.AS_OF, run_id=run_id)
    stored = lake.read_silver("slack").groupBy("project_key").agg(F.count("*").alias("messages"))
    series = lake.read_gold(fv.SENTIMENT_FEATURE_SET).groupBy("project_key").agg(F.sum("message_count").alias("in_series"))
    return stored.join(series, "project_key", "left").select("project_key", "messages", "in_series")


def q_expired_bronze(spark, sf_dir):
    """Bronze tickets of several dates, after those out of retention were deleted."""
    lake = Lake(spark, new_path(spark, "lake"))
    heads = star.ticket_heads(spark, sf_dir).select("issue_key", "project_key")
    for day in ("2024-01-01", "2024-02-15"):
        lake.write_bronze(heads, "jira", day)
    lake.expire_bronze(date(2024, 3, 1))
    stored = lake.read_bronze("jira", heads.schema)
    return stored.groupBy("project_key", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("tickets"))


def q_open_retrain_requests(spark, sf_dir):
    """Alerts stored, delivered and asked for; those served are left out."""
    envelopes = star.alert_envelopes(star.texts(spark, sf_dir, "events"))
    asked = alerts.retrain_requests(envelopes, ["PROJ", "ALPHA"], "event_id")
    lake = Lake(spark, new_path(spark, "lake"))
    monitoring.mark_served(lake, asked.where("event_id % 3 = 0"), "event_id")
    return monitoring.open_requests(lake, asked, "event_id")


def q_drift_alert(spark, sf_dir):
    """The alert that a drift of the features raises."""
    summary = drift.drift_summary(_drift(spark, sf_dir))
    raised = alerts.drift_alerts(summary, as_of=star.AS_OF)
    share = F.get_json_object("payload", "$.overall_drift_pct").cast("double")
    first = F.get_json_object("payload", "$.drifted_features[0]")
    return raised.select("alert_type", share.alias("overall_drift_pct"), first.alias("first_feature"), "created_at")


def q_catalog_table(spark, sf_dir):
    """A gold table registered in the catalog and queried by name."""
    lake = Lake(spark, new_path(spark, "lake"))
    heads = star.ticket_heads(spark, sf_dir).select("issue_key", "project_key", "rule_score")
    path = lake.write_gold(heads, run_date="2024-01-04")
    columns = [("issue_key", "string"), ("project_key", "string"), ("rule_score", "double")]
    partitions = [("project", "string"), ("date", "string")]
    table = register_table(spark, "lateline_checks", "risk_features", path, columns, partitions)
    return table.groupBy("project", "date").agg(F.count("*").alias("tickets"), F.max("rule_score").alias("top"))


def _feedback(spark, sf_dir):
    heads = star.ticket_heads(spark, sf_dir)
    key = F.col("order_key")
    project = F.when(key % 6 == 0, F.lower("project_key")).otherwise(F.col("project_key"))
    kind = F.when(key % 4 == 0, "approved").when(key % 4 == 1, "praised").when(key % 4 == 2, "rejected")
    report = F.to_json(F.struct(F.col("summary").alias("summary")))
    return heads.select("issue_key", project.alias("project_key"), kind.alias("feedback_type"), report.alias("edited_report"))


def q_feedback(spark, sf_dir):
    """Feedback stored and read back, and what was rejected."""
    from lateline.schemas import FEEDBACK

    lake = Lake(spark, new_path(spark, "lake"))
    _, rejected = lake.append_feedback(_feedback(spark, sf_dir), star.AS_OF)
    stored = lake.read_bronze("feedback", FEEDBACK)
    both = stored.select("project_key", "feedback_type", "timestamp", F.lit(True).alias("stored")).unionByName(
        rejected.select("project_key", "feedback_type", "timestamp", F.lit(False).alias("stored"))
    )
    return both.groupBy(*both.columns).agg(F.count("*").alias("records"))


# ---- streams ---------------------------------------------------------------


def _event_stream(spark, sf_dir):
    """The events as a stream of chat messages."""
    schema = star.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return star.messages_of(events)


def _drain(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def q_stream_sentiment(spark, sf_dir):
    timed = stream_sent.with_event_time(_event_stream(spark, sf_dir))
    out = new_path(spark, "windows")
    _drain(stream_sent.write_windows(stream_sent.windowed_sentiment(timed), out, out + "-checkpoint"))
    return stream_sent.read_windows(spark, out)


def q_stream_dedup(spark, sf_dir):
    """Every message delivered twice and stored once."""
    once = _event_stream(spark, sf_dir).select("event_id", "channel_id", "message_ts", "user_id")
    twice = once.unionByName(_event_stream(spark, sf_dir).select(*once.columns))
    kept = stream_sent.drop_redelivered(stream_sent.with_event_time(twice)).select("event_id", "channel_id", "user_id")
    out = new_path(spark, "messages")
    _drain(stream_sent.write_closed_windows(kept, out, out + "-checkpoint"))
    return spark.read.parquet(out)


def _ticket_stream(spark, sf_dir):
    path = _landed(star.raw_issue_pages(spark, sf_dir))
    pages = stream_silver_pages.page_stream(spark, path, star.POINTS_FIELD, star.SPRINT_FIELD)
    return stream_silver_pages.silver_tickets(pages, star.POINTS_FIELD, star.SPRINT_FIELD, star.AS_OF)


def q_stream_silver(spark, sf_dir):
    tickets = _ticket_stream(spark, sf_dir)
    out = new_path(spark, "silver")
    _drain(stream_silver_pages.write_silver(tickets, out, out + "-checkpoint"))
    mark = "_pii_redaction"
    return spark.read.parquet(out).select(
        "issue_key",
        "project",
        F.col("date").cast("string").alias("date"),
        "description",
        F.col(f"{mark}.pii_detected").alias("pii_detected"),
        F.array_join(f"{mark}.entity_types_found", ",").alias("entity_types"),
    )


def q_stream_lake(spark, sf_dir):
    """Landed page sets, some pages cut short, streamed into the lake: what its three places hold of each project."""
    lake, path = Lake(spark, new_path(spark, "lake")), _landed_sets(spark, sf_dir)
    _drain(stream_silver_pages.stream_pages(lake, path, star.POINTS_FIELD, star.SPRINT_FIELD, new_path(spark, "checkpoint"), run_date=star.AS_OF))
    silver = lake.read_silver("jira").groupBy("project_key").agg(F.count("*").alias("silver"))
    bronze = lake.read_bronze("jira", TICKET).groupBy("project_key").agg(F.count("*").alias("bronze"))
    rejects = read_rejects(lake).groupBy("project_key").agg(F.count("*").alias("rejects"))
    joined = silver.join(bronze, "project_key").join(rejects, "project_key", "left")
    return joined.select("project_key", "silver", "bronze", F.coalesce("rejects", F.lit(0)).alias("rejects"))


def q_updated_table(spark, sf_dir):
    """A registered table that gets a column and a day more: every row of both days, by the catalog."""
    lake, name = Lake(spark, new_path(spark, "lake")), f"updated_{uuid.uuid4().hex}"
    heads = settle(star.ticket_heads(spark, sf_dir).select("issue_key", "project_key", "status"), "heads")
    columns, by = [("issue_key", "string"), ("project_key", "string")], [("project", "string"), ("date", "string")]
    path = lake.write_gold(heads.drop("status"), run_date="2024-01-01")
    register_table(spark, "shop", name, path, columns, by)
    lake.write_gold(heads.where("status = 'Done'"), run_date="2024-01-02")
    return register_table(spark, "shop", name, path, [*columns, ("status", "string")], by).drop("project")


def q_stream_quality_alerts(spark, sf_dir):
    tickets = _ticket_stream(spark, sf_dir)
    out = new_path(spark, "alerts")
    _drain(stream_quality.check_batches(tickets, out, out + "-checkpoint", as_of=star.AS_OF))
    count = F.get_json_object("payload", "$.violations_count").cast("long")
    return spark.read.parquet(out).select("alert_type", "project_key", count.alias("violations"), "created_at")


def q_stream_anomalies(spark, sf_dir):
    """Drops among all windows of the stream, the open ones too."""
    columns = ("project_key", "window_start", "avg_sentiment", "z_score", "anomaly_type")
    return sent.sentiment_anomalies(q_stream_sentiment(spark, sf_dir)).select(*columns)


def q_stream_closed_anomalies(spark, sf_dir):
    timed = stream_sent.with_event_time(_event_stream(spark, sf_dir))
    series, found = new_path(spark, "series"), new_path(spark, "anomalies")
    windows = stream_sent.windowed_sentiment(timed)
    _drain(stream_sent.flag_closed_windows(windows, series, found, series + "-checkpoint"))
    stored = "project_key string, window_start string, avg_sentiment double, z_score double, anomaly_type string"
    return spark.read.schema(stored).parquet(found).drop("batch_id")


def queries():
    """name -> callable(spark, sf_dir)."""

    def run(function):
        def query(spark, sf_dir):
            return function(prepare(spark), sf_dir)

        return query

    return {name[2:]: run(f) for name, f in globals().items() if name.startswith("q_") and callable(f)}
