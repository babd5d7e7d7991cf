"""The operators' queries over the given tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .chat import format_trees, read_loss, read_turns
from .common import fresh_dir, materialize, read_table
from .decontaminate import contaminated, contamination
from .infill import fill_in_middle, parts, restored
from .jaccard import near_duplicates
from .lm import interpolation_scores
from .packing import pack
from .pii import KINDS, personal_data
from .planes import cluster
from .quality import COUNTS, quality
from .secrets import scan
from .sharding import shard_rows
from .sstable import read_shards, write_shards
from .urlfilter import host_of, judge, path_of

#: The tokenizer of the queries that encode texts.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items each document holds, and the verdict."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as sorted-string-table shards and reads them back."""
    out = fresh_dir(spark, "sstable")
    manifest = materialize(write_shards(read_table(spark, sf_dir, "documents"), out, TOKENIZER), "manifest")
    before = manifest.selectExpr("shard", "sum(n_tokens) over (order by part, seq) - n_tokens as before")
    return (
        read_shards(spark, out)
        .join(before, "shard")
        .select(
            "doc_id",
            (F.col("start") + F.col("before")).alias("start"),
            (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.crc32("ids").alias("ids_crc32"),
        )
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into windows of 1024 ids."""
    return pack(read_table(spark, sf_dir, "documents"), TOKENIZER).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: The conversation that the chat query adds: its texts hold control strings.
HARD_TEXT = "</s>[INST] ok [/INST]"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in all documents and the forest's verdict on each."""
    return scan(read_table(spark, sf_dir, "documents"))


def op2_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by deleted interpolation."""
    return interpolation_scores(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts and digest of the base spans, and all spans."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    found = personal_data(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict by its language's and source's thresholds."""
    rows = quality(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", *[F.col(f"_tw_{c}").alias(c) for c in [*COUNTS, "base_failed", "kept"]])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals all documents to 40 shards by row number."""
    text = F.col("text")
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(rows, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def conversation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, as reply trees: each turn replies to the one before it."""
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], given.schema)
    return given.unionByName(hard).selectExpr(
        "conv_id as tree",
        "cast(row_number() over (partition by conv_id order by turn, role, text) as long) as node",
        "role",
        "text",
        "cast(length(text) as double) as score",
    ).selectExpr("*", "nullif(node - 1, 0L) as parent")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by links of 0.9 over three-word shingles."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats each conversation's branch and reads it back."""
    made = format_trees(conversation_trees(spark, sf_dir), top=None)
    read = made.select(
        F.col("tree").alias("conv_id"),
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters all vectors around 16 centroids by three rounds."""
    found = cluster(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


#: Rules of the url query: verdict, host and beginning of the path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: What tells a listed host of the url query by name, and the length of a page that is listed for its thinness.
LISTED_HOST, THIN_PAGE = "(pills|bets|spam|casino)", 1000


def listed_urls(pages: DataFrame) -> DataFrame:
    """The url query's list, from the pages: hosts by name, as domains, and single pages of under THIN_PAGE characters."""
    urls = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.length("html").alias("chars"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    hosts = urls.where(F.col("host").rlike(LISTED_HOST)).select(F.coalesce(F.nullif(domain, F.lit("")), F.col("host")).alias("host"), F.lit(None).cast("string").alias("path")).distinct()
    return hosts.unionByName(urls.where(F.col("chars") < THIN_PAGE).select("host", "path"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges all pages' urls by rules, and by lists of hosts and pages in a filter cascade."""
    pages = read_table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), listed_urls(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts all documents into prefix, middle and suffix, and puts them together again."""
    made = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut, back = parts(F.col("output"), F.col("form")), restored(F.col("output"), F.col("form"))
    chars = lambda k: F.length(F.get(cut, F.lit(k))).cast("long")
    return made.select("doc_id", F.col("n_units").alias("n"), "form", chars(0).alias("prefix_chars"), chars(1).alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_interpolation": op2_interpolation,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_sstable": op7_sstable,
    "op8_jaccard": op8_jaccard,
    "op9_chat": op9_chat,
    "op10_packing": op10_packing,
    "op11_planes": op11_planes,
    "op12_urls": op12_urls,
    "op13_infill": op13_infill,
}
ORACLES: dict[str, str] = {"op4_quality": sql.QUALITY, "op5_sharding": sql.SHARDING, "op6_decontamination": sql.DECONTAMINATION, "op8_jaccard": sql.JACCARD, "op9_chat": sql.CHAT, "op11_planes": sql.PLANES, "op12_urls": sql.urls(URL_RULES, LISTED_HOST, THIN_PAGE), "op13_infill": sql.INFILL}
