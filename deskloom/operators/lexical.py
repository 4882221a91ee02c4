"""TF-IDF over words and word pairs: statistics, weights and exact search."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from deskloom import fixed, kernels
from deskloom.functions import text as t
from deskloom.operators import blocks, postings
from deskloom.session import stage

# Terms of a vocabulary that may be sent to every task; about 40 bytes each.
SENT_TERMS = 1_000_000

# How tables of terms are compressed: they are the largest part of an index.
COMPRESSION = "zstd"

# Terms that the summary of a task holds; about 100 bytes each.
SUMMARY_TERMS = 1_000_000

TALLY = T.ArrayType(T.StructType().add("term", T.StringType()).add("tf", T.IntegerType()))
POSTINGS = T.ArrayType(
    T.StructType().add("slot", T.LongType()).add("tf", T.IntegerType()).add("weight", T.DoubleType())
)


def with_lists(rows: DataFrame, lists: str, name: str, kind: T.DataType, made, values: int | None = None) -> DataFrame:
    """Rows with a list column replaced by what made gives for it, of a bounded number of values at once."""
    schema = T.StructType([T.StructField(name, kind) if field.name == lists else field for field in rows.schema])
    return rows.mapInArrow(lambda batches: kernels.mapped_lists(batches, lists, name, made, values), schema)


def terms(texts: DataFrame, *keep: str, text: str = "content", stop_words=fixed.STOP_WORDS) -> DataFrame:
    """Texts with their distinct terms and counts, an array per row.

    A text is one row already, so its terms are counted inside the row and
    nothing is shuffled.
    """
    stop = sorted(stop_words)

    def counted(words: pa.Array) -> pa.Array:
        return kernels.word_terms(words, pa.array(stop, pa.string()))

    return with_lists(texts.select(*keep, t.words(F.col(text), ()).alias("_words")), "_words", "terms", TALLY, counted)


def term_counts(texts: DataFrame, key: str, *carry: str, text: str = "content", stop_words=fixed.STOP_WORDS) -> DataFrame:
    """(key, term, tf): how often each term occurs in each text, one text per row."""
    counted = terms(texts, key, *carry, text=text, stop_words=stop_words)
    return counted.select(key, *carry, F.inline("terms"))


def term_statistics(counts: DataFrame) -> DataFrame:
    """Corpus and document frequency of every term; combines on the map side."""
    return counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


def most_frequent(stats: DataFrame, size: int) -> DataFrame:
    """The size terms of the highest total, ties by term.

    A histogram of the totals tells where the cut lies, to within two per cent.
    Only terms at or above it are sorted, so the last step sees little more
    than size rows and not size rows of every part. Reads stats twice: they
    should be a written table.
    """
    step = F.floor(F.log("total") * 50).cast("int")
    steps = stats.groupBy(step.alias("step")).agg(F.count("*").alias("n"))
    # One row per step, some thousand at most.
    above = F.sum("n").over(Window.orderBy(F.desc("step")))
    reached = steps.withColumn("above", above).where(F.col("above") >= size)
    cut = F.coalesce(reached.agg(F.max("step")).scalar(), F.lit(0))
    return stats.where(step >= cut).orderBy(F.desc("total"), "term").limit(size)


def heavy_statistics(counted: DataFrame, size: int, capacity: int = SUMMARY_TERMS) -> DataFrame:
    """Exact statistics of the terms that can be among the `size` most frequent, written.

    Rows with terms, a written table, are summarised in their tasks: what is moved
    is `capacity` terms of a task at most, not every term of the corpus. The
    merged summaries bound every term's total: it has at least what they count,
    and at most what they lack besides. Terms whose upper bound reaches the
    size-th lower bound are then counted exactly in a second scan. Where the
    summaries lack nothing, as with fewer terms than their capacity, they are the
    statistics; where they lack more than the size-th lower bound, the capacity is
    too small to tell and all terms are counted.
    """
    summary = counted.select("terms").mapInArrow(
        lambda batches: kernels.heavy_terms(batches, capacity), "term string, total long, df long"
    )
    merged = stage(summary.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")), "summary")
    lacking = merged.where("term is null").agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    found = merged.where("term is not null")
    if not lacking:
        return found
    least = most_frequent(found, size).agg(F.count("*").alias("n"), F.min("total").alias("total")).first()
    if least["n"] < size or least["total"] <= lacking:
        return stage(term_statistics(counted.select(F.inline("terms"))), "statistics")
    likely = stage(found.where(F.col("total") + lacking >= least["total"]).select("term"), "likely-terms")
    each = counted.select(F.inline("terms")).join(likely, "term", "left_semi")
    return stage(term_statistics(each), "statistics")


def changed_statistics(stats: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Term statistics without the texts that are gone and with those that came.

    gone and come: rows with terms. Reads one row per term of the old statistics
    and the terms of the changed texts; the other texts aren't looked at.
    """
    parts = [stats.select("term", "total", "df")]
    for rows, sign in ((gone, -1), (come, 1)):
        found = rows.select(F.inline("terms"))
        parts.append(found.select("term", (F.col("tf").cast("bigint") * sign).alias("total"), F.lit(sign).cast("bigint").alias("df")))
    # One sum over all: a term's rows meet once.
    each = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return each.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).where("df > 0")


def vocabulary(stats: DataFrame, n_docs: Column, size: int | None = fixed.VOCABULARY) -> DataFrame:
    """The most frequent terms with their smoothed inverse document frequency.

    stats is a written table. (term, slot, total, df, idf), written. Slots are
    numbers in no order that means anything. Without a size all terms are kept.
    """
    top = stats if size is None else most_frequent(stats, size)
    idf = F.log((n_docs + 1) / (F.col("df") + 1)) + 1
    # Written before anything reads the numbers.
    return stage(
        top.select("term", F.monotonically_increasing_id().alias("slot"), "total", "df", idf.alias("idf")), "vocabulary"
    )


def weigh(counted: DataFrame, vocab: DataFrame, *keep: str) -> DataFrame:
    """(*keep, postings): unit tf-idf vectors of rows with terms, by slot.

    A vocabulary of up to SENT_TERMS terms is sent to the tasks and nothing is
    shuffled; a larger one is joined, and vectors are put together by the first
    of the kept columns.
    """
    spark = counted.sparkSession
    known = vocab.select("term", "slot", "idf").limit(SENT_TERMS + 1).toArrow()
    if known.num_rows <= SENT_TERMS:
        sent = spark.sparkContext.broadcast(
            (
                known.column("term").combine_chunks(),
                known.column("slot").to_numpy().astype(np.int64),
                known.column("idf").to_numpy().astype(float),
            )
        )

        def weighed(terms: pa.Array) -> pa.Array:
            return kernels.weigh(terms, sent.value)

        # A look-up makes a table of the vocabulary each time.
        values = max(kernels.PART_VALUES, 2 * known.num_rows)
        return with_lists(counted.select(*keep, "terms"), "terms", "postings", POSTINGS, weighed, values)
    each = counted.select(*keep, F.inline("terms")).join(vocab.select("term", "slot", "idf"), "term")
    raw = F.struct("slot", "tf", (F.col("tf") * F.col("idf")).alias("weight"))
    found = each.groupBy(*keep).agg(F.array_sort(F.collect_list(raw)).alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda total, p: total + p["weight"] * p["weight"]))
    found = found.withColumn("_length", length)
    unit = F.transform(
        "raw", lambda p: F.struct(p["slot"].alias("slot"), p["tf"].alias("tf"), (p["weight"] / F.col("_length")).alias("weight"))
    )
    return found.select(*keep, unit.alias("postings"))


def term_weights(weights: DataFrame, vocab: DataFrame, *keep: str) -> DataFrame:
    """(*keep, term, slot, tf, weight): vectors as one row per term."""
    return weights.select(*keep, F.inline("postings")).join(vocab.select("term", "slot"), "slot")


class Index:
    """The lexical index as tables: documents, vocabulary, and one vector per document.

    counts and statistics are what the vocabulary was made of: the terms of every
    document, and of every term its total and document frequency. A saved index
    keeps them, so that a refresh counts changed documents only; it also has the
    vectors as blocks, which a search can skip.
    """

    def __init__(
        self,
        documents: DataFrame,
        vocab: DataFrame,
        weights: DataFrame | None,
        counts: DataFrame | None = None,
        statistics: DataFrame | None = None,
        blocks: DataFrame | None = None,
    ):
        self.documents = documents
        self.vocab = vocab
        self._weights = weights  # doc_id, domain, postings
        self.counts = counts  # doc_id, domain, terms
        self.statistics = statistics  # term, total, df
        self.blocks = blocks  # see postings.blocks

    @property
    def weights(self) -> DataFrame:
        if self._weights is None:
            self._weights = weigh(self.counts, self.vocab, "doc_id", "domain")
        return self._weights


def build_index(
    documents: DataFrame, size: int | None = fixed.VOCABULARY, stop_words=fixed.STOP_WORDS, summary: int | None = None
) -> Index:
    """Index of documents (doc_id, domain, content).

    Terms are counted once, inside each row, and written. Frequencies and
    weights are made from that table; no text is shuffled. With a summary, of so
    many terms a task, only terms that can be in the vocabulary are shuffled; such
    an index has no statistics of the others, so it isn't one to save and refresh.
    """
    counted = stage(terms(documents, "doc_id", "domain", stop_words=stop_words), "counts", compression=COMPRESSION)
    if summary and size is not None:
        made = weighed_index(documents, counted, heavy_statistics(counted, size, summary), size)
        made.statistics = None
        return made
    return weighed_index(documents, counted, term_statistics(counted.select(F.inline("terms"))), size)


def weighed_index(documents: DataFrame, counted: DataFrame, stats: DataFrame, size: int | None) -> Index:
    """The index of counted documents (doc_id, domain, terms) with given statistics."""
    stats = stage(stats, "terms", compression=COMPRESSION)
    vocab = vocabulary(stats, counted.agg(F.count("*")).scalar(), size)
    return Index(documents, vocab, weigh(counted, vocab, "doc_id", "domain"), counted, stats)


def query_weights(queries: DataFrame, vocab: DataFrame, *keep: str, stop_words=fixed.STOP_WORDS) -> DataFrame:
    """Unit tf-idf vectors of queries (query_id, query) as (query_id, postings)."""
    counted = terms(queries, "query_id", *keep, text="query", stop_words=stop_words)
    return weigh(counted, vocab, "query_id", *keep)


def first_documents(documents: DataFrame, n: int) -> DataFrame:
    """The n first documents of every domain and of all ("").

    Two window limits: n per part and domain first, so a hot domain is cut down
    before it is moved.
    """
    keyed = documents.select("doc_id", "domain")
    per_domain = Window.partitionBy("domain").orderBy("doc_id")
    by_domain = keyed.withColumn("place", F.row_number().over(per_domain)).where(F.col("place") <= n)
    overall = keyed.orderBy("doc_id").limit(n).withColumn("domain", F.lit(""))
    overall = overall.withColumn("place", F.row_number().over(per_domain))
    return by_domain.unionByName(overall)


def pack_queries(block: pa.Table) -> tuple:
    """What a task needs of a block of queries (query_id, domain_filter, postings):
    ids, domains, and the postings by slot, known slots first."""
    values, owner, _ = kernels.flat_lists(block.column("postings"))
    slot = values.field("slot").to_numpy(zero_copy_only=False)
    weight = values.field("weight").to_numpy(zero_copy_only=False)
    # Query terms get their own small numbers.
    known, number = np.unique(slot, return_inverse=True)
    order = np.lexsort((owner, number))
    starts = np.r_[0, np.cumsum(np.bincount(number, minlength=len(known)))]
    ids = block.column("query_id").combine_chunks()
    return (ids, *blocks.domain_filters(block), known, starts, owner[order], weight[order])


def top_documents(
    queries: DataFrame,
    index: Index,
    n: int,
    drop_zero: bool = False,
    stop_words=fixed.STOP_WORDS,
    block_rows: int = blocks.BLOCK_QUERIES,
) -> DataFrame:
    """The n best documents of every query by tf-idf cosine, ranked.

    queries: query_id, query, domain_filter. The domain is looked at before the
    cut. Documents that share no term score zero and still fill the list up to
    n, first documents first, unless drop_zero is set.

    A search of vectors is a scan: every task scores its own documents and passes
    on n rows per query. An index with blocks reads the largest weights of each
    block and then only the blocks that can hold a hit; the result is the same.

    Returns query_id, doc_id, score, rank.
    """
    queries = queries.where("query != ''").select(
        "query_id", "query", F.coalesce("domain_filter", F.lit("")).alias("domain_filter")
    )
    packed = query_weights(queries, index.vocab, "domain_filter", stop_words=stop_words).where(F.size("postings") > 0)
    out = ", ".join(
        f"{a} {df.schema[a].dataType.simpleString()}" for a, df in (("query_id", queries), ("doc_id", index.documents))
    ) + ", score double, fits boolean"

    if index.blocks is not None:
        found = blocks.each(
            packed, lambda sent, asked: postings.search(sent, asked, index.blocks, n, out), pack_queries, block_rows
        )
    else:

        def score(batches, sent):
            return kernels.sparse_top(batches, sent, n)

        found = blocks.search(packed, index.weights.select("doc_id", "domain", "postings"), pack_queries, score, out, block_rows)
    found = blocks.best(found, n).select("query_id", "doc_id", "score", "rank")
    if drop_zero:
        return found
    fill = queries.select("query_id", "domain_filter").join(
        first_documents(index.documents, n), F.col("domain_filter") == F.col("domain")
    )
    fill = fill.select("query_id", "doc_id", F.lit(0.0).alias("score"))
    # A document may be both a hit and a filler: the hit counts. At most 2n
    # rows per query are left at this point.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    both = found.drop("rank").unionByName(fill).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
