"""Corpus quality: recency, conflicting sources, misfiled documents, language."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from deskloom import fixed, kernels
from deskloom.functions import exact, text as t
from deskloom.operators import lexical, order
from deskloom.session import stage

# Gains per word and domain that are sent to every task: 64 MB.
SENT_GAINS = 8_000_000
# Domains a corpus may have; the driver holds a number for each.
DOMAINS = 1_000_000
# Characters of a sequence that language profiles count, sequences of all profiles, and languages.
GRAM = 3
PROFILE_GRAMS = 50_000
LANGUAGES = 200


def prefer_recent(hits: DataFrame) -> DataFrame:
    """Re-rank hits (query_id, fused_rank, doc_date, depth): newer first, then
    more specific (deeper), then the fused order. Undated documents come last."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("doc_date"), F.desc("depth"), "fused_rank")
    return hits.withColumn("preferred_rank", F.row_number().over(order))


def path_depth(path: Column) -> Column:
    """How specific a document is: the number of folders it lies in."""
    return F.size(F.split(path, "/")) - 1


def disagreement(hits: DataFrame, days: int = 365) -> DataFrame:
    """Per query, whether its sources may contradict each other.

    From hits (query_id, domain, topic, doc_date): dates of one topic that lie
    more than some days apart, or sources of several domains. Returns query_id,
    sources, stale (the first), mixed (the second) and low_confidence (either).
    A query has few hits, and groups combine on the map side.
    """
    topics = hits.groupBy("query_id", "domain", "topic").agg(
        F.count("*").alias("n"), F.min("doc_date").alias("first"), F.max("doc_date").alias("last")
    )
    found = topics.groupBy("query_id").agg(
        F.sum("n").alias("sources"),
        F.max(F.coalesce(F.datediff("last", "first") > days, F.lit(False))).alias("stale"),
        (F.min("domain") != F.max("domain")).alias("mixed"),
    )
    return found.withColumn("low_confidence", F.col("stale") | F.col("mixed"))


def misfiled(documents: DataFrame) -> DataFrame:
    """(doc_id, domain, best_domain, misfiled): the domain whose wording fits
    each document best, by add-one smoothed word frequencies.

    score(document, domain) is the sum over the document's words of
    log((n + 1) / (words of the domain + distinct words)), n being how often the
    domain has the word. Every domain is scored for every document, over all
    words, a tile of domains at a time, and the best is found inside the task.
    Without words there is no best domain. The words of documents without a
    domain count as distinct words only.

    A word that no document of a domain has adds nothing, so only gains log(n +
    1) travel. Those of the most frequent words are sent to the tasks, as many
    as SENT_GAINS allows: any of the others is in a small share of the rows, so
    the join on them has no hot key. Domains get numbers in the order of their
    names and are joined by them; the driver holds one number per domain, their
    sizes, and DOMAINS bounds them.
    """
    texts = documents.select("doc_id", "domain", t.words(F.col("content")).alias("_words"))
    counted = stage(lexical.with_lists(texts, "_words", "words", lexical.TALLY, kernels.tally), "words")
    each = counted.select("domain", F.inline("words"))
    model = stage(each.groupBy("term", "domain").agg(F.sum("tf").alias("n")), "model")
    stats = stage(model.groupBy("term").agg(F.sum("n").alias("total")), "totals")
    sizes = model.where("domain is not null").groupBy("domain").agg(F.sum("n").alias("size"))
    domains = stage(order.placed(sizes, "domain").withColumn("place", F.col("place") - 1), "domains")
    found = domains.orderBy("place").select("size").limit(DOMAINS + 1).toArrow().column("size").to_numpy()
    if len(found) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    base = found + stats.count()
    gain = F.struct("place", F.log(F.col("n") + 1).alias("gain"))
    placed = model.join(domains.select("domain", "place"), "domain").select("term", gain.alias("gain"))
    gains = placed.groupBy("term").agg(F.collect_list("gain").alias("gains"))
    top = stage(lexical.most_frequent(stats, max(1, SENT_GAINS // max(1, len(base)))).select("term"), "head")

    tail = gains.join(top, "term", "left_anti")
    # Few documents share a word of the tail, and all gains of a document fit in its row.
    rare = counted.select("doc_id", F.inline("words")).join(top, "term", "left_anti").join(tail, "term")
    per_place = rare.select("doc_id", "tf", F.inline("gains")).groupBy("doc_id", "place")
    summed = per_place.agg(exact.total(F.col("tf") * F.col("gain")).alias("gain"))
    packed = summed.groupBy("doc_id").agg(F.collect_list(F.struct("place", "gain")).alias("tail"))
    judged = _judge(counted, packed, gains.join(top, "term", "left_semi"), base)
    named = domains.select(F.col("place").alias("_best"), F.col("domain").alias("best_domain"))
    return judged.join(named, "_best", "left").select(
        "doc_id",
        "domain",
        "best_domain",
        F.coalesce(F.col("domain") != F.col("best_domain"), F.lit(False)).alias("misfiled"),
    )


def _judge(counted: DataFrame, tail: DataFrame, head: DataFrame, base) -> DataFrame:
    """(doc_id, domain, _best): the number of each document's best domain."""
    spark = counted.sparkSession
    sent = head.toArrow()  # SENT_GAINS values at most
    values, row, n = kernels.flat_lists(sent.column("gains"))
    table = np.zeros((n, len(base)))
    if n:
        table[row, values.field("place").to_numpy(zero_copy_only=False)] = values.field("gain").to_numpy(zero_copy_only=False)
    shipped = spark.sparkContext.broadcast((sent.column("term").combine_chunks(), table, np.log(base.astype(float))))

    def judge(batches):
        terms, gains, logs = shipped.value
        return kernels.best_domain(batches, logs, (terms, gains))

    rows = counted.join(tail, "doc_id", "left").select("doc_id", "domain", "words", "tail")
    kind = counted.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, domain string, _best long")


def language(text: Column, profiles=fixed.LANGUAGE_WORDS) -> Column:
    """The language whose function words a text uses most; ties by name, null
    if it uses none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))

    def score(words: Column, place: int, name: str) -> Column:
        hits = F.size(F.filter(words, lambda w: w.isin(profiles[name])))
        return F.struct(hits.alias("hits"), F.lit(-place).alias("order"), F.lit(name).alias("language"))

    def best(words: Column) -> Column:
        top = F.array_max(F.array(*[score(words, place, name) for place, name in enumerate(sorted(profiles))]))
        return F.struct(F.when(top["hits"] > 0, top["language"]).alias("language"))

    # The words are bound to one variable, so they are extracted once.
    return F.transform(F.array(found), best)[0]["language"]


GRAMS = T.ArrayType(T.StructType().add("gram", T.StringType()).add("tf", T.IntegerType()))


def grams(texts: DataFrame, *keep: str, text: str = "content", size: int = GRAM) -> DataFrame:
    """(*keep, grams): the character sequences of each text's words, counted inside the row."""

    def counted(words: pa.Array) -> pa.Array:
        return kernels.word_grams(words, size)

    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))
    return lexical.with_lists(texts.select(*keep, found.alias("_words")), "_words", "grams", GRAMS, counted)


def learn_profiles(labelled: DataFrame, label: str, text: str = "content", most: int = PROFILE_GRAMS) -> DataFrame:
    """(gram, language, weight): profiles of the languages of labelled texts, written.

    The weight is the log of the gram's add-one smoothed share of a language's
    grams, in thousandths, a whole number; sums of weights are exact. A row without
    gram holds the weight of grams that a language lacks. Of all grams the `most`
    frequent count, ties by gram. Rows without label aren't learned from. Counts
    combine on the map side, so a frequent language is no hot key.
    """
    counted = grams(labelled.where(F.col(label).isNotNull()), label, text=text).select(
        F.col(label).cast("string").alias("language"), F.inline("grams")
    )
    counts = stage(counted.groupBy("gram", "language").agg(F.sum("tf").alias("n")), "grams")
    total = counts.groupBy("gram").agg(F.sum("n").alias("total"))
    known = lexical.most_frequent(stage(total.withColumnRenamed("gram", "term"), "gram-totals"), most)
    known = stage(known.select(F.col("term").alias("gram")), "known-grams")
    kept = counts.join(known, "gram")
    sizes = kept.groupBy("language").agg(F.sum("n").alias("size")).withColumn("size", F.col("size") + known.count())

    def weight(n):
        return F.round(F.log(n / F.col("size")) * 1000).cast("bigint").alias("weight")

    seen = kept.join(F.broadcast(sizes), "language").select("gram", "language", weight(F.col("n") + 1))
    unseen = sizes.select(F.lit(None).cast("string").alias("gram"), "language", weight(F.lit(1)))
    return stage(seen.unionByName(unseen), "profiles")


def detect(texts: DataFrame, profiles: DataFrame, *keep: str, text: str = "content") -> DataFrame:
    """(*keep, language): the language whose profile a text fits best, by the sum of
    its grams' weights; ties by name, null if it has no gram that any language has.

    Profiles are sent to the tasks: PROFILE_GRAMS grams of LANGUAGES languages at
    most, an error beyond that.
    """
    names = [row["language"] for row in profiles.where("gram is null").orderBy("language").limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    place = {name: i for i, name in enumerate(names)}
    rows = profiles.toArrow().to_pydict()
    known = sorted({gram for gram in rows["gram"] if gram is not None})
    at = {gram: i for i, gram in enumerate(known)}
    unseen = np.zeros(len(names), np.int64)
    for gram, name, weight in zip(*rows.values(), strict=True):
        if gram is None:
            unseen[place[name]] = weight
    weights = np.tile(unseen, (len(known), 1))
    for gram, name, weight in zip(*rows.values(), strict=True):
        if gram is not None:
            weights[at[gram], place[name]] = weight
    sent = texts.sparkSession.sparkContext.broadcast((pa.array(known, pa.string()), weights, names))

    def likeliest(grams: pa.Array) -> pa.Array:
        return kernels.likeliest(grams, *sent.value)

    return lexical.with_lists(grams(texts, *keep, text=text), "grams", "language", T.StringType(), likeliest)
