"""Injection scan, personal data and second opinions on tickets."""

from pyspark.sql import Column, DataFrame, functions as F

from deskloom import fixed
from deskloom.functions import safety as s, text as t


def normalised(df: DataFrame, text: str) -> DataFrame:
    """Add _text, the normalised text, computed once per row."""
    return t.once(df, {"_text": t.normalise(F.col(text))})


def injections(df: DataFrame, text: str = "_text") -> DataFrame:
    """Add injection_reasons and regex_injection for a column of normalised text."""
    out = df.withColumn("_possible", s.possible_rules(s.gate_text(F.col(text))))
    none = F.array().cast("array<string>")
    found = F.when(F.size("_possible") > 0, s.injection_reasons(text, "_possible")).otherwise(none)
    out = t.once(out, {"injection_reasons": found})
    return out.withColumn("regex_injection", F.size("injection_reasons") > 0).drop("_possible")


def personal_data(df: DataFrame, text: str = "_text") -> DataFrame:
    """Add pii_types and pii_detected for a column of normalised text.

    Apart from the injection rules, which a job that needs only this doesn't run.
    """
    out = df.withColumn("_gates", s.pii_gates(F.col(text)))
    out = out.withColumn("_masked", s.mask_cards(F.col(text), F.col("_gates")))
    out = t.once(out, {"pii_types": s.pii_types(F.col(text), F.col("_masked"), F.col("_gates"))})
    return out.withColumn("pii_detected", F.size("pii_types") > 0).drop("_gates", "_masked")


def scan(df: DataFrame, text: str) -> DataFrame:
    """Add injection_reasons, pii_types and the two flags for a text column.

    Each stage is its own projection, so the normalised text, its lower-case
    form and the card-masked copy are computed once per row.
    """
    return personal_data(injections(normalised(df, text))).drop("_text")


def wants_second_opinion(company: Column, force: bool = False) -> Column:
    """Whether a ticket's text goes to the semantic scorer: suspicious or of no
    known company, but not if personal data is its only signal."""
    unknown = F.lower(t.null_safe(company)).isin("", "none")
    pii_only = F.col("pii_detected") & ~F.col("regex_injection")
    return ~pii_only & (F.col("regex_injection") | unknown | F.lit(force))


def second_opinion(tickets: DataFrame, scores: DataFrame | None, force: bool = False) -> DataFrame:
    """Fuse the table of semantic scores (ticket_id, label, score).

    The threshold is lower when a rule fired already. A ticket without a score
    keeps the verdict of the rules.
    """
    wanted = tickets.withColumn("opinion_wanted", wants_second_opinion(F.col("company"), force))
    if scores is None:
        wanted = wanted.withColumns({"label": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    else:
        one = scores.groupBy("ticket_id").agg(F.max(F.struct("score", "label")).alias("_best"))
        one = one.select("ticket_id", "_best.label", "_best.score")
        wanted = wanted.join(one, "ticket_id", "left")
    ran = F.col("opinion_wanted")
    bar = F.when(F.col("regex_injection"), fixed.SCORE_CONFIRMING).otherwise(fixed.SCORE_SOLE_SIGNAL)
    agrees = F.coalesce(ran & (F.col("label") == "INJECTION") & (F.col("score") >= bar), F.lit(False))
    note = F.format_string("deberta:%s@%.2f", "label", "score")
    fused = wanted.withColumns(
        {
            "opinion_label": F.when(ran, F.coalesce("label", F.lit("unavailable"))),
            "opinion_score": F.when(ran, F.coalesce("score", F.lit(0.0))),
            "injection_reasons": F.when(agrees, F.concat("injection_reasons", F.array(note))).otherwise(
                F.col("injection_reasons")
            ),
            "is_injection": F.col("regex_injection") | agrees,
        }
    )
    return fused.drop("label", "score")


def summary() -> Column:
    """One line on the verdict, "clean" if there is nothing to say."""
    parts = F.concat_ws(
        "; ",
        F.when(F.col("is_injection"), F.concat(F.lit("INJECTION ("), F.array_join("injection_reasons", ", "), F.lit(")"))),
        F.when(F.col("pii_detected"), F.concat(F.lit("PII ("), F.array_join("pii_types", ", "), F.lit(")"))),
        F.when(F.col("opinion_wanted"), F.format_string("DeBERTa=%s(%.2f)", "opinion_label", "opinion_score")),
    )
    return F.when(parts == "", "clean").otherwise(parts)
