"""Scoring behind a cache: only inputs not seen before go to the scorer, whatever it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import stored

COST_PER_TOKEN = 0.042e-6
ANSWER = "struct<type:string,noul:double,choice:string,probabilities:map<string,double>,confidence:double,score:double,legend:map<string,string>>"


def digest(*seen: Column) -> Column:
    """SHA-1 of everything a scorer sees."""
    return F.sha1(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in seen])).cast("binary"))


def scored(inputs: DataFrame, cache: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> tuple[DataFrame, DataFrame]:
    """(all scores, the fresh ones to append): inputs with `digest` that the cache lacks go through mapInPandas(scorer), each digest once.

    schema: the scorer's columns, digest among them, as in the cache. Fresh scores are stored, so both
    results hold the same answers and the scorer is paid once.
    """
    fresh = stored(inputs.join(cache.select("digest"), "digest", "left_anti").dropDuplicates(["digest"]).mapInPandas(scorer, schema))
    return inputs.join(cache.unionByName(fresh), "digest", "left"), fresh


def parsed_answers(rows: DataFrame, column: str = "response") -> DataFrame:
    """rows with answers (a map of typed answers), tokens and error: an unknown kind or unreadable text is an error, not an answer."""
    got = F.from_json(column, f"answers map<string,{ANSWER}>, input_tokens long, latency_ms double")
    kinds = F.transform(F.map_values("_r.answers"), lambda a: a["type"])
    out = rows.withColumn("_r", got)
    bad = F.when(F.col("_r.answers").isNull(), "unreadable").when(F.exists(kinds, lambda k: ~F.coalesce(k.isin("noul", "choice", "score"), F.lit(False))), "unknown kind")
    return out.select("*", F.when(bad.isNull(), F.col("_r.answers")).alias("answers"), F.col("_r.input_tokens").alias("tokens"), F.col("_r.latency_ms").alias("latency_ms"), bad.alias("error")).drop("_r")


def cost(tokens: Column) -> Column:
    return F.sum(tokens * F.lit(COST_PER_TOKEN))


def normalised(score: Column, legend: Column) -> Column:
    """A rubric score over the rubric's length, 0 to 1."""
    top = F.greatest(F.size(F.map_keys(legend)) - 1, F.lit(1))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / top))


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def entropy_confidence(p: Column) -> Column:
    """1 minus the entropy over its largest value: 1 for a sure answer, 0 for an even one."""
    h = F.aggregate(p, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(0.0))
    return F.when(F.size(p) > 1, 1 - h / F.ln(F.size(p).cast("double"))).otherwise(1.0)


def signal_gate(rows: DataFrame, least_strength: float = 0.0, least_confidence: float = 0.5) -> DataFrame:
    """Rows with a side, strength above zero and at least the threshold, and confidence at least the other."""
    return rows.filter((F.col("sign") != 0) & (F.col("strength") > 0) & (F.col("strength") >= least_strength) & (F.col("confidence") >= least_confidence))


def headline_risk(moves: Column, severity: Column, fresh: Column, denied: Column, informed: Column) -> Column:
    """moves * severity * (0.2 + 0.8 fresh) * (1 - 0.93 denied), at least 0.85 informed."""
    return F.greatest(moves * severity * (0.2 + 0.8 * fresh) * (1 - 0.93 * denied), 0.85 * informed)


def stance(risk: Column, p_up: Column, p_down: Column, confidence: Column, has_headline: Column, imbalance: Column, floor: float = 0.30, widen_max: float = 8.0, sure: float = 0.45, pull: float = 0.6, both: float = 2.0) -> Column:
    """Struct (name, bid_spread_mult, ask_spread_mult, bid_size_mult, ask_size_mult): normal, widen both, pull one side or stand aside."""
    strength = F.least(F.lit(1.0), (risk - floor) / (1 - floor))
    wide = 1 + strength * (widen_max - 1)
    lean = F.when(has_headline, p_up - p_down).otherwise(imbalance)
    clear = F.when(has_headline, (confidence >= sure) & (F.abs(p_up - p_down) > 0.2)).otherwise(F.abs(imbalance) > 0.3)
    one = F.lit(1.0)
    name = F.when(risk < floor, "normal").when(strength >= both, "stand aside").when(~clear, "widen both").when(lean > 0, "pull offer").otherwise("pull bid")
    calm, aside, unclear = risk < floor, strength >= both, ~clear
    mult = lambda mine: F.when(calm, one).when(aside | unclear | mine, wide).otherwise(one)
    size = lambda mine: F.when(calm, one).when(aside, 0.0).when(unclear, one).when(mine & (strength > pull), 0.0).otherwise(one)
    return F.struct(name.alias("name"), mult(lean <= 0).alias("bid_spread_mult"), mult(lean > 0).alias("ask_spread_mult"), size(lean <= 0).alias("bid_size_mult"), size(lean > 0).alias("ask_size_mult"))


def inventory_words(x: Column) -> Column:
    size = F.when(F.abs(x) > 4, "heavily").otherwise("modestly")
    return F.when(F.abs(x) < 0.5, "flat").otherwise(F.concat(size, F.when(x > 0, " long").otherwise(" short")))


def flow_words(x: Column) -> Column:
    return (
        F.when(x > 0.6, "almost every recent trade has been someone buying from us").when(x > 0.25, "recent trades have leaned towards people buying from us")
        .when(x < -0.6, "almost every recent trade has been someone selling to us").when(x < -0.25, "recent trades have leaned towards people selling to us").otherwise("buying and selling have been roughly balanced")
    )


# Gates and sizes of the decision policy.
POLICY = {"max_units": 0.1, "hazard_max": 0.70, "cut_threshold": 0.65, "liquidity_min": 0.40, "min_confidence": 0.20, "conviction_floor": 0.30, "edge_deadband": 0.10, "continuation_boost": 0.45, "reversal_damp": 0.60, "confidence_weight": 0.5, "gain": 1.6, "rebalance_deadband": 0.18}


def decision(answers: DataFrame, policy: dict | None = None) -> DataFrame:
    """answers (p_up, p_down, confidence, p_continue, p_reverse, conviction, liquidity, hazard, cut, position) with edge, ideal, gate and target.

    Six gates in order: disorderly, cut_position, low_confidence, weak_setup, no_edge, and illiquid, which only
    stops a position from growing. Changes within the dead band keep the position, except going flat.
    """
    p = POLICY | (policy or {})
    c = F.col
    edge = c("p_up") - c("p_down")
    follow = F.greatest(F.lit(0.25), F.least(F.lit(1.5), 1 + p["continuation_boost"] * c("p_continue") - p["reversal_damp"] * c("p_reverse")))
    raw = edge * c("conviction") * follow * (1 - p["confidence_weight"] + p["confidence_weight"] * c("confidence")) * p["gain"]
    ideal = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)) * p["max_units"]
    gate = (
        F.when(c("hazard") > p["hazard_max"], "disorderly").when(c("cut") > p["cut_threshold"], "cut_position").when(c("confidence") < p["min_confidence"], "low_confidence")
        .when(c("conviction") < p["conviction_floor"], "weak_setup").when(F.abs(edge) < p["edge_deadband"], "no_edge")
        .when((c("liquidity") < p["liquidity_min"]) & (F.abs(ideal) > F.abs(c("position"))), "illiquid").otherwise("")
    )
    out = answers.withColumn("edge", edge).withColumn("gate", gate).withColumn("ideal", F.when(gate == "", ideal).when(gate == "illiquid", c("position")).otherwise(0.0))
    still = (F.abs(c("ideal") - c("position")) < p["rebalance_deadband"] * p["max_units"]) & ~((c("ideal") == 0) & (c("position") != 0))
    return out.withColumn("target", F.when(still, c("position")).otherwise(c("ideal")))


def second_stage(first: DataFrame, gate: Column, scorer, schema: str, agree: str = "agree", unaffected: str = "unaffected") -> DataFrame:
    """first (id, ...) with `confirm`: only rows past the gate are scored again; (1 - unaffected) * agree, 0 without a second stage."""
    second = first.filter(gate).mapInPandas(scorer, schema)
    confirm = (1 - F.col(unaffected)) * F.col(agree)
    return first.join(second.select("id", confirm.alias("confirm")), "id", "left").fillna(0.0, ["confirm"])
