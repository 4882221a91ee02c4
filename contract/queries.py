"""The registered queries: thin wiring of the package to the driver's tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from contract import inputs as i
from deskloom import fixed
from deskloom.functions import safety as s, text as t
from deskloom.operators import (
    chunking,
    conversations,
    dense,
    lexical,
    manifest,
    metrics,
    order,
    quality,
    safety,
    validation,
)
from deskloom.plans import index as ix, retrieval, triage as tr
from deskloom.session import new_folder, spread, stage
from deskloom.sources import corpus, tickets as files

QUERIES = {}


def query(f):
    """Register a query; whole numbers come out as bigint, as in the SQL."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = f(spark, sf)
        wide = {c: F.col(c).cast("bigint") for c, kind in df.dtypes if kind == "int"}
        return df.withColumns(wide) if wide else df

    QUERIES[f.__name__] = run
    return f


def joined(column: str):
    return F.array_join(column, "|").alias(column)


# --- safety on documents ------------------------------------------------------


def personal_data(spark, sf):
    return safety.personal_data(safety.normalised(spread(i.documents(spark, sf), "doc_id"), "content"))


@query
def pii_types(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data(spark, sf).select("doc_id", "pii_detected", joined("pii_types"))


@query
def pii_type_counts(spark, sf):
    found = personal_data(spark, sf)
    return found.select(F.explode("pii_types").alias("pii_type")).groupBy("pii_type").agg(F.count("*").alias("n"))


@query
def redact_text(spark, sf):
    docs = spread(i.documents(spark, sf), "doc_id")
    return docs.select("doc_id", s.redact(F.col("content")).alias("redacted"))


@query
def redact_strict(spark, sf):
    docs = t.once(spread(i.documents(spark, sf), "doc_id"), {"plain": t.normalise(F.col("content"))})
    return docs.select("doc_id", s.redact(F.col("plain"), strict=True).alias("redacted"))


# --- conversations ------------------------------------------------------------


@query
def conversation_rollup(spark, sf):
    return conversations.roll_up(i.turns(spark, sf))


@query
def last_user_message(spark, sf):
    return conversations.last_user_message(i.turns(spark, sf))


@query
def issue_json_roundtrip(spark, sf):
    parsed = conversations.parse_conversations(i.tickets(spark, sf))
    return parsed.select("ticket_id", "conversation_text", "last_user_message")


@query
def ticket_query(spark, sf):
    parsed = conversations.parse_conversations(i.src.clean_inputs(i.tickets(spark, sf)))
    asked = conversations.add_domain_filter(conversations.add_query(parsed), i.COMPANIES)
    return asked.select("ticket_id", "query", "domain_filter")


# --- injection ----------------------------------------------------------------


def disguised(column):
    """Every "e " becomes a Cyrillic e, an invisible character and two blanks."""
    return F.replace(column, F.lit("e "), F.lit("е​  "))


@query
def normalise_text(spark, sf):
    rows = spread(i.turns(spark, sf), "conv_id", "turn")
    return rows.select("conv_id", "turn", t.normalise(disguised(F.col("text"))).alias("normalised"))


@query
def injection_scan(spark, sf):
    found = tr.screen(i.tickets(spark, sf), i.COMPANIES)
    return found.select("ticket_id", "regex_injection", "pii_detected", joined("injection_reasons"), joined("pii_types"))


@query
def injection_by_family(spark, sf):
    found = tr.screen(i.tickets(spark, sf), i.COMPANIES)
    return metrics.rule_recall(found.withColumn("hit", F.col("regex_injection")))


@query
def rule_tally(spark, sf):
    found = tr.screen(i.tickets(spark, sf), i.COMPANIES)
    cases = found.withColumn("ok", F.col("regex_injection") == (F.col("family") != "none"))
    return metrics.tally(cases, group="family")


@query
def document_injections(spark, sf):
    found = safety.injections(safety.normalised(spread(i.documents(spark, sf), "doc_id"), "content"))
    return found.select("doc_id", "regex_injection", joined("injection_reasons"))


@query
def planted_rules(spark, sf):
    """Every document with a text of one injection rule or personal-data type
    behind it, so that each of them fires."""
    docs = spread(i.documents(spark, sf), "doc_id")
    planted = docs.withColumn("planted", F.concat("content", F.lit("\n"), i.pick(i.EXAMPLES, F.col("doc_id"))))
    found = safety.scan(planted, "planted")
    return found.select("doc_id", joined("injection_reasons"), joined("pii_types"))


@query
def planted_tally(spark, sf):
    """How many of the planted texts of each rule and type were found."""
    docs = spread(i.documents(spark, sf), "doc_id").select(
        i.pick(i.EXAMPLES, F.col("doc_id")).alias("planted"), i.pick(i.EXPECTED, F.col("doc_id")).alias("expected")
    )
    found = safety.scan(docs, "planted")
    hit = F.array_contains(F.concat("injection_reasons", "pii_types"), F.col("expected"))
    return metrics.tally(found.withColumn("ok", hit), group="expected")


@query
def normalise_compatible(spark, sf):
    """Letters and digits in their full-width form come back as they were."""
    rows = spread(i.turns(spark, sf), "conv_id", "turn")
    wide = F.translate("text", i.NARROW, i.WIDE)
    return rows.select("conv_id", "turn", t.normalise(wide).alias("normalised"))


@query
def second_opinion(spark, sf):
    found = tr.screen(i.tickets(spark, sf), i.COMPANIES, i.injection_scores(spark, sf))
    return found.select(
        "ticket_id", "opinion_wanted", "opinion_label", "opinion_score", "is_injection",
        joined("injection_reasons"), "safety_flags",
    )


# --- corpus -------------------------------------------------------------------


@query
def corpus_manifest(spark, sf):
    """Pages as corpus files: the path of a page is its host and URL path."""
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    files = i.table(spark, sf, "pages").select(
        "page_id", path.alias("rel_path"), F.col("html").alias("content"), F.lit(None).cast("timestamp").alias("mtime")
    )
    records = corpus.corpus_records(files, "data")
    return records.select("doc_path", "domain", "topic", "subtopic", "content_hash")


@query
def corpus_stats(spark, sf):
    return manifest.statistics(i.documents(spark, sf))


def versions(spark, sf):
    """An older and a newer corpus: Spanish documents are new, German ones are
    gone, French ones changed."""
    docs = i.documents(spark, sf)
    changed = F.when(F.col("domain") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    old = docs.where("domain != 'es'").withColumn("content_hash", F.sha2("content", 256))
    new = docs.where("domain != 'de'").withColumn("content", changed)
    return old, new.withColumn("content_hash", F.sha2("content", 256))


@query
def manifest_delta(spark, sf):
    return manifest.delta(*versions(spark, sf))


@query
def incremental_refresh(spark, sf):
    """Character counts kept for unchanged documents, made again for the others."""
    old, new = versions(spark, sf)
    kept = old.select("doc_path", F.lit(-1).alias("characters"))
    changes = manifest.delta(old, new)
    return manifest.refresh(
        kept, new, changes, lambda d: d.select("doc_path", F.char_length("content").alias("characters"))
    )


# --- lexical index and search ---------------------------------------------------


@query
def term_df(spark, sf):
    return lexical.term_statistics(lexical.term_counts(spread(i.documents(spark, sf), "doc_id"), "doc_id"))


@query
def tfidf_weights(spark, sf):
    index = lexical.build_index(spread(i.documents(spark, sf), "doc_id"))
    return lexical.term_weights(index.weights, index.vocab, "doc_id").select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def ranked(df):
    return df.withColumn("score", F.round("score", 6))


@query
def tfidf_topk(spark, sf):
    index = lexical.build_index(spread(i.documents(spark, sf), "doc_id"))
    return ranked(lexical.top_documents(i.queries(spark, sf), index, 24))


@query
def tfidf_topk_nonzero(spark, sf):
    index = lexical.build_index(spread(i.documents(spark, sf), "doc_id"))
    return ranked(lexical.top_documents(i.queries(spark, sf, False), index, 24, drop_zero=True))


@query
def index_roundtrip(spark, sf):
    """The search over an index that was written to the shared folder and loaded."""
    folder = new_folder(spark, "index")
    ix.save(ix.build(spread(i.documents(spark, sf), "doc_id")), folder, take=True)
    index = ix.load(spark, folder, with_vectors=False)
    return ranked(lexical.top_documents(i.queries(spark, sf), index.lexical, 24))


@query
def summarised_topk(spark, sf):
    """The search over an index whose vocabulary comes from summaries of the tasks."""
    docs = spread(i.documents(spark, sf), "doc_id")
    index = lexical.build_index(docs, 200, summary=20_000)
    return ranked(lexical.top_documents(i.queries(spark, sf), index, 24))


@query
def index_refresh(spark, sf):
    """Term weights of an index that was brought up to date, as those of a new
    one. The new corpus comes without the texts of unchanged documents, so none
    of them can have been counted again."""
    old, new = versions(spark, sf)
    folder, newer = new_folder(spark, "index"), new_folder(spark, "index")
    ix.save(ix.build(old), folder, take=True)
    same = manifest.delta(old, new).where("status = 'same'").select("doc_path", F.lit(True).alias("same"))
    bare = new.join(same, "doc_path", "left").withColumn("content", F.when(F.col("same").isNull(), F.col("content")))
    index = ix.refresh(spark, folder, newer, bare.drop("same")).lexical
    found = lexical.term_weights(index.weights, index.vocab, "doc_id")
    return found.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query
def clustered_topk(spark, sf):
    """The nearest documents over an index that was saved with its vectors in clusters."""
    folder = new_folder(spark, "index")
    vectors = i.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = labelled(spark, sf).select("doc_id", "domain", F.lit("one two").alias("content"))
    ix.save(ix.build(docs, vectors), folder, take=True)
    return ranked(dense.top_documents(dense_queries(spark, sf), ix.load(spark, folder).clusters, 24))


# --- dense search ---------------------------------------------------------------


def labelled(spark, sf):
    return i.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("domain"), "embedding"
    )


def dense_queries(spark, sf, domain=None):
    wanted = F.lit(None).cast("string") if domain is None else domain
    asked = i.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), wanted.alias("domain_filter"))
    return asked.join(i.query_vectors(spark, sf), "query_id")



@query
def dense_topk_short(spark, sf):
    """The first query and every seventh have a vector that is too short: they
    find nothing, and the others what they find without them."""
    asked = dense_queries(spark, sf)
    cut = F.when(F.col("query_id") % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return ranked(dense.top_documents(asked.withColumn("embedding", cut), labelled(spark, sf), 24))


@query
def unit_vectors(spark, sf):
    units = dense.normalise_vectors(labelled(spark, sf))
    return units.select("doc_id", F.posexplode("embedding").alias("place", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query
def dense_topk(spark, sf):
    return ranked(dense.top_documents(dense_queries(spark, sf), labelled(spark, sf), 24))


@query
def dense_topk_domain(spark, sf):
    label = F.pmod("item_id", F.lit(10)).cast("string")
    return ranked(dense.top_documents(dense_queries(spark, sf, label), labelled(spark, sf), 24))


@query
def dense_topk_prefilter(spark, sf):
    label = F.pmod("item_id", F.lit(10)).cast("string")
    return ranked(dense.top_documents(dense_queries(spark, sf, label), labelled(spark, sf), 24, prefilter=True))


# --- fusion, chunks, snippets -----------------------------------------------------


def fused_columns(df, *more):
    return df.select(
        "query_id", "doc_id", "fused_rank",
        F.coalesce("semantic_rank", F.lit(0)).alias("semantic_rank"),
        F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"),
        F.round("semantic_score", 6).alias("semantic_score"),
        F.round("lexical_score", 6).alias("lexical_score"),
        F.round("fused_score", 6).alias("fused_score"),
        F.round("rrf_sum", 6).alias("rrf_sum"),
        *more,
    )


def hybrid_index(spark, sf):
    return ix.build(spread(i.documents(spark, sf), "doc_id"), i.vectors(spark, sf))


@query
def rrf_fusion(spark, sf):
    index = hybrid_index(spark, sf)
    return fused_columns(retrieval.candidates(i.queries(spark, sf), index, i.query_vectors(spark, sf)))


@query
def chunk_documents(spark, sf):
    return chunking.chunk(spread(i.documents(spark, sf).select("doc_id", "content"), "doc_id"))


@query
def hybrid_topk(spark, sf):
    index = hybrid_index(spark, sf)
    hits = retrieval.hybrid_topk(i.queries(spark, sf), index, i.query_vectors(spark, sf))
    return fused_columns(hits, "doc_path", "snippet", "is_full_file")


def chunk_hits(spark, sf):
    """Every document is a hit of the query whose number is its own modulo 40."""
    ids = i.documents(spark, sf).select("doc_id")
    return ids.select(F.pmod("doc_id", F.lit(40)).alias("query_id"), "doc_id")


@query
def chunk_topk(spark, sf):
    """The chosen chunks of every document for one query."""
    docs = i.documents(spark, sf)
    index = lexical.build_index(docs)
    asked = i.queries(spark, sf)
    hits = chunk_hits(spark, sf)
    chunks = stage(chunking.chunk(spread(docs, "doc_id").select("doc_id", "content")), "chunks")
    rank = chunking.rank_chunks_lexical(hits, chunks, asked, index.vocab)
    best = chunking.join_chunks(chunking.best_chunks(rank), chunks)
    return best.select("query_id", "doc_id", F.array_join("chunk_numbers", ",").alias("chunk_numbers"), "snippet")


@query
def chunk_topk_dense(spark, sf):
    """The same by vectors of chunks and queries: tf-idf weights hashed to 64 places."""
    docs = i.documents(spark, sf)
    index = lexical.build_index(docs)
    chunks = stage(chunking.chunk(spread(docs, "doc_id").select("doc_id", "content")), "chunks")
    counted = lexical.terms(chunks, "doc_id", "chunk_no", text="chunk")
    weights = lexical.weigh(counted, index.vocab, "doc_id", "chunk_no")
    places = i.placed(index.vocab)
    chunk_vectors = i.hashed(lexical.term_weights(weights, places, "doc_id", "chunk_no"), "doc_id", "chunk_no")
    asked = lexical.query_weights(i.queries(spark, sf), index.vocab)
    query_vectors = i.hashed(lexical.term_weights(asked, places, "query_id"), "query_id")
    rank = chunking.rank_chunks_dense(chunk_hits(spark, sf), chunk_vectors, query_vectors)
    best = chunking.best_chunks(rank)
    return best.select("query_id", "doc_id", "chunk_no", F.round("similarity", 6).alias("similarity"), "place")


# --- model outputs, routing, output -------------------------------------------------


def screened(spark, sf):
    return tr.screen(i.tickets(spark, sf), i.COMPANIES, i.injection_scores(spark, sf))


def canned_hits(tickets):
    """Three hits per ticket, none for tickets without a known company: stands
    in for retrieval where a query is about the steps after it."""
    paths = F.array(*[F.concat(F.lit(f"data\\{n}\\"), "ticket_id") for n in "abc"])
    none = F.array().cast("array<string>")
    known = F.col("domain_filter").isNotNull()
    return tickets.withColumns({"has_docs": known, "hit_paths": F.when(known, paths).otherwise(none)})


@query
def classify_clamp(spark, sf):
    rows = tr.classify(screened(spark, sf), i.classifications(spark, sf), i.COMPANIES)
    return rows.select(
        "ticket_id", "language", "true_company", "product_area", "request_type", "risk_level", "reasoning"
    )


def decided(spark, sf):
    rows = tr.classify(canned_hits(screened(spark, sf)), i.classifications(spark, sf), i.COMPANIES)
    return tr.decide(rows)


@query
def route_decision(spark, sf):
    return decided(spark, sf).select("ticket_id", "status", joined("reasons"))


@query
def response_clamp(spark, sf):
    rows = tr.respond(decided(spark, sf), i.responses(spark, sf), i.tools(spark))
    names = F.transform(
        F.from_json("answer.actions_taken", "array<struct<action:string,name:string>>"),
        lambda a: F.coalesce(F.nullif(a["action"], F.lit("")), a["name"]),
    )
    return rows.select(
        "ticket_id", "answer.response", "answer.justification", "answer.confidence_score",
        "answer.source_documents", F.array_join(names, ",").alias("action_names"),
    )


@query
def triage(spark, sf):
    """The whole triage with hybrid retrieval over the corpus."""
    models = tr.Models(
        i.classifications(spark, sf), i.responses(spark, sf), i.injection_scores(spark, sf), i.ticket_vectors(spark, sf)
    )
    return tr.triage(i.tickets(spark, sf), hybrid_index(spark, sf), i.tools(spark), i.COMPANIES, models)


@query
def triage_failures(spark, sf):
    """Rows with a gap, every third by a missing area and every fifth by a
    missing answer, take the safe default as a whole."""
    rows = tr.respond(decided(spark, sf), i.responses(spark, sf), i.tools(spark))
    gap = lambda n, name: F.when(F.col("conv_id") % n != 0, F.col(name))
    return tr.output_row(rows.withColumns({"product_area": gap(3, "product_area"), "answer": gap(5, "answer")}))


@query
def classification_prompts(spark, sf):
    return tr.classification_prompts(screened(spark, sf))


@query
def response_prompts(spark, sf):
    """One prompt per ticket with its numbered documents (lexical retrieval)."""
    index = ix.build(i.documents(spark, sf))
    tickets = screened(spark, sf)
    hits = retrieval.hybrid_topk(tr.ticket_queries(tr.ask(i.tickets(spark, sf), i.COMPANIES)), index)
    routed = tr.decide(tr.classify(tr.attach_hits(tickets, hits), i.classifications(spark, sf), i.COMPANIES))
    return tr.response_prompts(routed, i.tools(spark))


# --- validation ---------------------------------------------------------------------

FAULTY = {
    "status": ["replied", "Escalated ", "open", ""],
    "request_type": ["bug", "INVALID", "none", "product_issue", ""],
    "response": ["ok", " ", "fine"],
    "confidence_score": ["0.5", "1.5", "high", "", "-0.1", "1"],
    "risk_level": ["low", "HIGH", "severe", ""],
    "pii_detected": ["true", "False", "yes", ""],
    "language": ["en", "", "english"],
    "actions_taken": ["[]", '{"a":1}', "", "[1", '[{"action":"x"}]'],
}


def faulty_output(spark, sf):
    """An output table with planted faults, one row per document."""
    docs = i.documents(spark, sf)
    return docs.select("doc_id", *[i.pick(values, F.col("doc_id")).alias(c) for c, values in FAULTY.items()])


@query
def output_findings(spark, sf):
    return validation.row_findings(faulty_output(spark, sf), "doc_id").select("row_no", "severity", "check")


@query
def output_check_summary(spark, sf):
    """Row findings, header and count findings of a faulty table against more inputs."""
    faulty = faulty_output(spark, sf).withColumn("unasked", F.lit(1))
    found = validation.validate(i.turns(spark, sf), faulty, "doc_id")
    return validation.summary(found)


@query
def output_report(spark, sf):
    found = validation.row_findings(faulty_output(spark, sf), "doc_id")
    return validation.report(found).select("row_no", "severity", "check")


# --- evaluation ---------------------------------------------------------------------


def judged(spark, sf):
    """Labels as truth: a document of good quality should be replied to; a
    document with personal data counts as escalated."""
    rows = personal_data(spark, sf).join(i.table(spark, sf, "labels"), "doc_id")
    return rows.select(
        "doc_id",
        "pii_detected",
        (F.col("toxic") == 1).alias("toxic"),
        F.when(F.col("pii_detected"), "escalated").otherwise("replied").alias("status"),
        F.when(F.col("quality") == 1, "Replied").otherwise("Escalated ").alias("gold_status"),
        (F.round(F.pmod(F.char_length("content"), F.lit(101)) / 100, 2)).alias("confidence"),
        (F.col("quality") == 1).alias("correct"),
    )


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def routing_f1(spark, sf):
    return rounded(metrics.routing_f1(judged(spark, sf)), "precision", "recall", "f1")


@query
def brier(spark, sf):
    return rounded(metrics.brier(judged(spark, sf)), "brier", "spread")


@query
def calibration_bins(spark, sf):
    return rounded(metrics.calibration(judged(spark, sf)), "mean_confidence", "share_correct")


@query
def pii_confusion(spark, sf):
    """Every third document has personal data planted; that is the truth."""
    docs = spread(i.documents(spark, sf), "doc_id").withColumn("planted", F.col("doc_id") % 3 == 0)
    more = F.concat("content", F.lit("\n"), i.pick(list(i.PERSONAL.values()), F.col("doc_id")))
    text = F.when(F.col("planted"), more).otherwise(F.col("content"))
    found = safety.personal_data(safety.normalised(docs.withColumn("text", text), "text"))
    return metrics.confusion(found, "pii_detected", "planted")


def citing(spark, sf):
    """Every page cites the document of its number, and a made-up one."""
    pages = i.table(spark, sf, "pages")
    return pages.select(
        F.col("page_id").alias("ticket_id"),
        F.concat(F.lit("doc/"), "page_id", F.lit(" | |doc/x"), F.pmod("page_id", F.lit(3))).alias("source_documents"),
    )


@query
def citation_missing(spark, sf):
    known = i.documents(spark, sf).select(F.concat(F.lit("doc/"), "doc_id").alias("doc_path"))
    return metrics.missing_citations(metrics.citations(citing(spark, sf)), known)


@query
def pii_echo(spark, sf):
    """A response that repeats the second half of its document."""
    docs = spread(i.documents(spark, sf), "doc_id")
    half = F.floor(F.char_length("content") / 2).cast("int")
    rows = docs.withColumn("reply", F.substring(F.col("content"), half + 1, F.char_length("content")))
    found = metrics.pii_echo(rows, "content", "reply")
    return found.select("doc_id", F.array_join(F.array_sort("echoed"), "|").alias("echoed"))


@query
def run_diff(spark, sf):
    """Two runs over the documents that differ where the language is French."""
    first = i.table(spark, sf, "documents").select("source", "lang", "n_chars")
    second = first.withColumn("n_chars", F.when(F.col("lang") == "fr", F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return metrics.run_diff(first, second)


@query
def run_determinism(spark, sf):
    """The same screening on two partitionings: no row may differ."""
    cols = ("ticket_id", "is_injection", "pii_detected", "safety_flags", "safe_conversation")
    first = screened(spark, sf).select(*cols)
    again = tr.screen(
        i.tickets(spark, sf).repartition(3, "subject"), i.COMPANIES, i.injection_scores(spark, sf)
    ).select(*cols)
    return metrics.run_diff(stage(first, "first-run"), stage(again, "second-run")).agg(F.count("*").alias("different"))


@query
def tool_conformance(spark, sf):
    rows = i.responses(spark, sf).select(
        "ticket_id", F.get_json_object("raw_json", "$.actions_taken").alias("actions_taken")
    )
    checked = metrics.tool_conformance(rows, i.tools(spark))
    return checked.select(
        "ticket_id", "position", "action", "known", joined("missing"), joined("unknown"), joined("wrong_type"),
        joined("wrong_value"), "unverified"
    )


# --- corpus quality -------------------------------------------------------------------

DATES = ["2026-03-16T20:39:36Z", None, "Feb 19, 2026, 3:31 PM", "2017-07-18T16:48:39.721Z"]


@query
def recency_rank(spark, sf):
    """Lexical hits, newer documents first; dates from generated front matter."""
    index = lexical.build_index(i.documents(spark, sf))
    hits = lexical.top_documents(i.queries(spark, sf), index, 24, drop_zero=True)
    key = i.pick(["last_updated_iso", "title", "last_updated_exact", "last_modified"], F.col("doc_id"))
    head = F.concat(F.lit('---\n'), key, F.lit(': "'), F.coalesce(i.pick(DATES, F.col("doc_id")), F.lit("none")), F.lit('"\n---\n'))
    front = corpus.front_matter(head)["front"]
    path = F.concat(F.lit("data/"), F.repeat(F.lit("sub/"), F.pmod("doc_id", F.lit(3)).cast("int")), F.lit("a.md"))
    dated = hits.withColumn("doc_date", corpus.front_date(front)).withColumn("depth", quality.path_depth(path))
    best = quality.prefer_recent(dated.withColumnRenamed("rank", "fused_rank"))
    return best.select("query_id", "doc_id", F.col("doc_date").cast("string").alias("doc_date"), "depth", "preferred_rank")


@query
def source_disagreement(spark, sf):
    """Queries whose sources are of several domains or of dates far apart."""
    docs = i.documents(spark, sf)
    hits = lexical.top_documents(i.queries(spark, sf, False), lexical.build_index(docs), 24, drop_zero=True)
    dates = [None, "2026-03-16 20:39:36", "2026-02-19 15:31:00", "2017-07-18 16:48:39"]
    dated = hits.join(docs.select("doc_id", "domain", "topic"), "doc_id").withColumn(
        "doc_date", i.pick(dates, F.col("doc_id")).cast("timestamp")
    )
    return quality.disagreement(dated)


@query
def documents_without_vector(spark, sf):
    return ix.without_vectors(hybrid_index(spark, sf))


# --- files ----------------------------------------------------------------------------


@query
def ticket_files(spark, sf):
    """Tickets written as two folders of several CSV files each, the second much
    larger, and read back in the order of the files and their lines."""
    folder = new_folder(spark, "tickets")
    rows = i.tickets(spark, sf).select("conv_id", F.col("issue").alias("Issue"), F.col("subject").alias("Subject"), F.col("company").alias("Company"))
    for name, part in (("a", "conv_id % 5 = 0"), ("b", "conv_id % 5 != 0")):
        sorted_files = rows.where(part).repartitionByRange(4, "conv_id").sortWithinPartitions("conv_id").drop("conv_id")
        sorted_files.write.options(**files.WRITTEN).csv(f"{folder}/{name}")
    back = files.read_tickets(spark, f"{folder}/*")
    return order.placed(back, "ticket_id").select("place", "issue", "subject", "company")


@query
def output_files(spark, sf):
    """An output table, with whole texts, written as CSV in input order and read back."""
    folder = new_folder(spark, "output")
    docs = i.documents(spark, sf)
    rest = [F.concat(F.lit(f"{c} \"x\", "), F.col("doc_id").cast("string")).alias(c) for c in fixed.OUTPUT_COLUMNS[1:]]
    rows = docs.select(F.col("doc_id").alias("ticket_id"), F.col("content").alias("issue"), *rest)
    files.write_output(rows.repartition(5), folder)
    back = files.numbered(files.read_table(spark, folder, "_file"))
    return order.placed(back, "ticket_id").select("place", *fixed.OUTPUT_COLUMNS)


@query
def corpus_files(spark, sf):
    """Documents written as one file each and read back as a corpus, numbered in
    the order of their paths. One folder below the root has the root's own name."""
    root = f"{new_folder(spark, 'corpus')}/topic=src0"
    docs = i.table(spark, sf, "documents").withColumnsRenamed({"lang": "domain", "source": "topic"})
    rows = docs.select("domain", "topic", F.col("doc_id").alias("page"), "text")
    i.write_files(rows, root)
    back = corpus.read_corpus(spark, root, pattern="*.txt")
    # A path ends in the part's name, which only the writer knows; a folder holds one file.
    # The order is made in two passes: the files are read once, the records twice.
    return order.placed(stage(back, "corpus"), "doc_id").select("place", "domain", "topic", "subtopic", "content", "content_hash")


@query
def broken_files(spark, sf):
    """Corpus files whose bytes are no valid UTF-8: what cannot be read is left out."""
    root = new_folder(spark, "broken")
    docs = i.table(spark, sf, "documents").withColumnsRenamed({"lang": "domain", "source": "topic"})
    cut = F.shiftright(F.length("text"), 1)
    # A stray byte, an unfinished sign, half a pair of surrogates.
    pieces = [F.lit(b"\xff"), F.substring("text", F.lit(1), cut).cast("binary"), F.lit(b"\xe2\x82 \xed\xa0\x80"),
              F.substring("text", cut + 1, F.length("text")).cast("binary"), F.lit(b"\xc3")]
    rows = docs.select("domain", "topic", F.col("doc_id").alias("page"), F.concat(*pieces).cast("string").alias("text"))
    i.write_files(rows, root)
    back = corpus.read_corpus(spark, root, pattern="*.txt")
    return back.select("subtopic", F.regexp_replace("content", " ", "_").alias("content"))


@query
def checked_files(spark, sf):
    """Findings of the validator over two written CSV folders: the tickets, and
    an output table with planted faults."""
    folder = new_folder(spark, "checked")
    turns = i.turns(spark, sf)
    turns.select("conv_id", F.col("text").alias("Issue")).write.options(**files.WRITTEN).csv(f"{folder}/in")
    faulty = faulty_output(spark, sf).withColumnsRenamed({c: c.replace("_", " ").title() for c in FAULTY})
    faulty.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.options(**files.WRITTEN).csv(f"{folder}/out")
    read = files.numbered(files.read_table(spark, f"{folder}/out", "_file"))
    found = validation.validate(files.read_table(spark, f"{folder}/in"), read.drop("ticket_id"), "doc_id")
    return found.select("row_no", "severity", "check")


@query
def tool_files(spark, sf):
    """Catalogues of every shape, made of the nations, written as JSON and read back."""
    tool = F.struct(F.concat(F.lit("of "), "n_name").alias("description"))
    rows = i.table(spark, sf, "nation")
    named = {c: F.to_json(F.collect_list(F.struct(F.col("n_name").alias(c), tool["description"].alias("description")))) for c in ("name", "action")}
    shapes = {
        **named,
        "keyed": F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", tool)))),
        "broken": F.concat(F.lit("["), F.max("n_name")),
    }
    found = []
    for shape, text in shapes.items():
        folder = new_folder(spark, f"tools-{shape}")
        rows.agg(text.alias("value")).write.text(folder)
        found.append(corpus.read_tools(spark, f"{folder}-none", folder).select(F.lit(shape).alias("shape"), "name", "description"))
    return reduce(DataFrame.unionByName, found)


@query
def manifest_files(spark, sf):
    """The manifest on disk against a newer corpus."""
    old, new = versions(spark, sf)
    folder = new_folder(spark, "manifest")
    manifest.write(old, folder)
    return manifest.delta(manifest.read(spark, folder), new)


@query
def odd_conversations(spark, sf):
    """Issues that are no well-formed list of messages."""
    docs = i.documents(spark, sf)
    odd = docs.select("doc_id", i.pick([issue for issue, *_ in i.ODD_ISSUES], F.col("doc_id")).alias("issue"))
    return conversations.parse_conversations(odd).select("doc_id", "conversation_text", "last_user_message")


@query
def misfiled_docs(spark, sf):
    return quality.misfiled(spread(i.documents(spark, sf), "doc_id"))


@query
def language_id(spark, sf):
    docs = spread(i.documents(spark, sf), "doc_id")
    return docs.select("doc_id", "domain", quality.language(F.col("content")).alias("language"))


@query
def language_accuracy(spark, sf):
    docs = spread(i.documents(spark, sf), "doc_id")
    found = docs.select("domain", quality.language(F.col("content")).alias("language"))
    return metrics.confusion(found, "language", "domain")


@query
def learned_language(spark, sf):
    """Languages by profiles learned from two documents of three; the third is held out."""
    docs = spread(i.documents(spark, sf), "doc_id").withColumn("held_out", F.col("doc_id") % 3 == 1)
    profiles = quality.learn_profiles(docs.where("not held_out"), "domain")
    found = quality.detect(docs, profiles, "held_out", "domain")
    return metrics.confusion(found, "language", "domain", "held_out")


@query
def language_profiles(spark, sf):
    docs = spread(i.documents(spark, sf), "doc_id")
    return quality.learn_profiles(docs.where("doc_id % 3 != 1"), "domain", most=2_000)
