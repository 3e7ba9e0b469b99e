"""Comparison of candidate renderings: which to make, how they score, which one is applied."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adlattice import vocab
from adlattice.functions.scoring import token_parameter
from adlattice.operators.scale import first_row

LISTS = {
    "poster": ["safe", "balanced", "letterbox", "object-aware-fit"],
    "product": ["safe", "balanced", "fill", "center-crop", "focus-fill", "object-aware-fit"],
    "general": ["safe", "balanced", "fill", "object-aware-fit"],
    "none": ["safe", "balanced", "fill"],
}


def creative_class() -> Column:
    """poster, product, general or none (no analysis); poster outranks product.

    Columns: analysis_id, reflow_recommended, layout_type, text_density, edge_risk, date_like, creative_type.
    """
    poster = (F.coalesce("reflow_recommended", F.lit(False)) | F.coalesce(F.col("layout_type").isin("poster_info", "horizontal_bands"), F.lit(False))
              | F.coalesce((F.col("text_density") == "high") & (F.col("edge_risk") == "high") & (F.col("date_like") >= 2), F.lit(False)))
    product = F.coalesce((F.col("creative_type") == "product_focused") | F.col("text_density").isin("low", "medium"), F.lit(False))
    return F.when(F.col("analysis_id").isNull(), "none").when(poster, "poster").when(product, "product").otherwise("general")


def strengths(kind: Column, bands: Column) -> Column:
    """Ordered candidate list of a class; a poster with content bands also gets its reflow."""
    out = None
    for name, words in LISTS.items():
        lit = F.array(*map(F.lit, words))
        if name == "poster":
            lit = F.when(bands > 0, F.array(*map(F.lit, [*words, "poster-reflow"]))).otherwise(lit)
        out = F.when(kind == name, lit) if out is None else out.when(kind == name, lit)
    return out


def candidate_rows(analyses: DataFrame) -> DataFrame:
    """One row per candidate to render, with its position."""
    kind = creative_class()
    return analyses.withColumn("class", kind).select("*", F.posexplode(strengths(F.col("class"), F.coalesce("bands", F.lit(0)))).alias("pos", "strength"))


def job_analysis(jobs: DataFrame, analyses: DataFrame, specs: DataFrame) -> DataFrame:
    """Comparison requests with their analysis, and an error when the job or the spec does not exist.

    ``jobs`` are requests: job_id, job_known, slug, analysis_id.
    """
    known = specs.select("slug").distinct().withColumn("_s", F.lit(True))
    a = analyses.withColumnRenamed("analysis_id", "_aid")
    joined = jobs.join(known, "slug", "left").join(a, F.col("analysis_id") == F.col("_aid"), "left")
    error = F.when(~F.col("job_known"), "JOB_NOT_FOUND").when(F.col("_s").isNull(), "SPEC_NOT_FOUND")
    return joined.withColumn("error", error).withColumn("analysis_id", F.col("_aid")).drop("_s", "_aid")


def join_scores(cands: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with the model's first entry for their strength; an unmatched one scores 0 and keeps null lists.

    ``answers``: keys, pos, strength, score (null for a non-number), pros, cons (null for a non-list).
    """
    best = first_row(answers.withColumn("_hit", F.lit(True)), [*keys, "strength"], ["pos"]).drop("pos")
    empty = F.array().cast("array<string>")
    joined = cands.join(best, [*keys, "strength"], "left")
    hit = F.col("_hit").isNotNull()
    return joined.withColumns({"score": F.coalesce(F.col("score").cast("int"), F.lit(0)),
                               "pros": F.when(hit, F.coalesce("pros", empty)), "cons": F.when(hit, F.coalesce("cons", empty))}).drop("_hit")


def best_score(verdicts: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Winner (an unknown name means balanced) and the score of its first candidate, 0 without one."""
    best = F.when(F.col("best").isin(*vocab.COMPARE_CANDIDATES), F.col("best")).otherwise("balanced")
    first = scored.groupBy(*keys, F.col("strength").alias("best")).agg(F.min_by("score", "pos").alias("_score"))
    return verdicts.withColumn("best", best).join(first, [*keys, "best"], "left").withColumn(
        "best_score", F.coalesce("_score", F.lit(0))).drop("_score")


def apply_candidate(choices: DataFrame, compares: DataFrame, cands: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged choices (error, path) and results with the chosen file set on the first result of the spec.

    ``choices``: choice_id, job_id, spec_id, compare_id, candidate.
    """
    heads = compares.select("compare_id", F.col("job_id").alias("_job"), F.col("spec_id").alias("_spec"))
    paths = cands.groupBy("compare_id", F.col("strength").alias("candidate")).agg(F.min_by("file_path", "pos").alias("path"))
    joined = choices.join(heads, "compare_id", "left").join(paths, ["compare_id", "candidate"], "left")
    error = (F.when(F.col("_job").isNull(), "COMPARE_NOT_FOUND").when(F.col("_job") != F.col("job_id"), "JOB_MISMATCH")
             .when(F.col("_spec") != F.col("spec_id"), "SPEC_MISMATCH").when(F.col("path").isNull(), "CANDIDATE_NOT_FOUND"))
    judged = joined.withColumn("error", error).drop("_job", "_spec")
    last = first_row(judged.filter("error IS NULL").select("job_id", "spec_id", "choice_id", "compare_id", "candidate", "path"),
                     ["job_id", "spec_id"], ["choice_id"], desc_last=True)
    first = results.groupBy("job_id", "spec_id").agg(F.min("ordinal").alias("ordinal"))
    hits = first.join(last, ["job_id", "spec_id"]).select("job_id", "ordinal", F.col("compare_id").alias("selected_compare"),
                                                         F.col("candidate").alias("selected_candidate"), F.col("path").alias("selected_path"))
    return judged, results.join(hits, ["job_id", "ordinal"], "left").withColumn("applied", F.col("selected_path").isNotNull())


def call_outcome(attempts: DataFrame, primary: str, fallback: str) -> DataFrame:
    """How each model call ends: at once, with the other token parameter, on the fallback model, or in an error.

    ``attempts``: call_id, attempt (0 first, 1 second), error_code.  Only the first two attempts matter.
    """
    per = attempts.groupBy("call_id").agg(
        F.max(F.when(F.col("attempt") == 0, F.coalesce("error_code", F.lit("")))).alias("e1"),
        F.max(F.when(F.col("attempt") == 1, F.coalesce("error_code", F.lit("")))).alias("e2"))
    swap, other = F.col("e1").isin("unsupported_parameter", "unknown_parameter"), F.col("e1").isin("model_not_found", "unsupported_model")
    ok2 = F.coalesce(F.col("e2") == "", F.lit(False))
    first = token_parameter(F.lit(primary))
    swapped = F.when(first == "max_tokens", "max_completion_tokens").otherwise("max_tokens")
    outcome = (F.when(F.col("e1") == "", "ok").when(swap & ok2, "param_corrected").when(swap, "param_retry_failed")
               .when(other & ok2, "fallback").when(other, "fallback_failed").otherwise("error"))
    return per.select(
        "call_id", outcome.alias("outcome"), F.when(outcome.isin("ok", "param_corrected"), primary).when(outcome == "fallback", fallback).alias("used_model"),
        F.when(outcome == "ok", first).when(outcome == "param_corrected", swapped).when(outcome == "fallback", token_parameter(F.lit(fallback))).alias("token_parameter"),
        F.when(outcome == "fallback", F.col("e1")).when(outcome == "param_corrected", F.concat(F.lit("param_corrected:"), first, F.lit("→"), swapped)).alias("reason"))
