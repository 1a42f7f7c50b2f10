"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poseweave.llm import chat, fingerprints, jaccard, language, pages, passages, runs, spelling, toxicity, vptree
from poseweave.llm.common import table
from poseweave.llm.mixing import mix
from poseweave.llm.packing import pack
from poseweave.llm.tokenfile import token_index, write_tokens
from poseweave.session import new_path, pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


@query("op10_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all documents, read them back and describe every document."""
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)


@query("op7_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into windows of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents")).drop("piece")


@query("op9_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to weights 1, 2, 3 over the sources."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op1_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with a model fitted on the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


@query("op8_jaccard_links")
def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents whose three-word shingle sets are alike to 0.9."""
    return jaccard.link(table(spark, sf_dir, "documents"))


@query("op3_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of all documents and of their edited texts."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op6_chat_format", sql="""
with rows as (
    select conv_id, turn, role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(case role when 'system' then 16 when 'user' then 14 else 8 end + length(text)
        + len(regexp_extract_all(text, '(\\[\\\\*/?INST\\]|<\\\\*/?s>|<\\\\*</?SYS>>|\\[\\\\*/?ROLE\\]|\\[\\\\*TEXT\\])'))) as bigint) as formatted_chars
from rows group by conv_id""")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that quotes control strings, write them, and describe what is read back."""
    extra = spark.sql("select -7L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role, '</s>[INST] ok [/INST]' as text from range(2)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_chats(pin(chat.format_chats(turns), "chats"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op4_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector, by exact search."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


@query("op2_page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return pages.extract(table(spark, sf_dir, "pages")).drop("n_shared")


@query("op5_fuzzy_passages")
def fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that documents of smaller id have, too."""
    return passages.repeats(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` whose every tenth text, by the checksum of its id, ends in a repeated period; a null id plants nothing.

    The words from ``a`` on repeat the ``p`` words from there.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = lambda words: F.size(words)
    cut = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def repeated(words):
        a = F.pmod(g, F.greatest(n(words), F.lit(1))).cast("int")
        p = (1 + F.floor((n(words) - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        spots = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda s: F.transform(
            words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, s["a"] + F.pmod(i - s["a"], s["p"])))))
        return F.array_join(spots[0], " ")

    planted = F.transform(F.array(cut), repeated)[0]
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")))


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three periods and 24 words in all documents, every tenth of them with a planted period."""
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), digests=True)
    # The strongest run: a longer one of equal exponent, compared exactly, does not replace an earlier one.
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    found = found.withColumn("_best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
                        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op13_language")
def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by dictionaries learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    told = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return told.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")


@query("op12_spelling")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents, one of 199 words misspelt."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), one_in=199))
