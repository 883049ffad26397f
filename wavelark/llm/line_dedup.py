"""Recurring lines by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: the number of tokens, then two of the first LEADING tokens, with tokens that hold a digit as a
wildcard. A line stands in one leaf for each choice of the two, so a field may vary at any place, the first ones included. In a
leaf a token that fewer than min_docs documents have at its place is a variable field and becomes a wildcard too; what is left
is the line's template there. Dropped are lines of a template that min_docs documents share, and lines that min_docs documents
have word for word. All counts are of different documents.

Most documents have one kind of line in a leaf, and their number by kind simply adds up; only those with several are
listed and counted one by one. So what moves is small even where a line stands in a third of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.llm.common import discard, materialize, releasing, same_columns, unpack

MIN_DOCS = 10
#: Of the first three tokens two are fixed in a leaf.
LEADING = 3
#: Least share of a template's tokens that are constant.
CONSTANT = 0.5
WILD = "<*>"


def masked(line: Column) -> Column:
    """Tokens (between single spaces) that hold a digit become the wildcard."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", WILD)).otherwise(line)


def _texts(docs: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """text, and a document's key: its id and a hash of its text, so rows that repeat both are one document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.col(f"`{id_col}`").cast("long")
    return docs.select(*extra, F.coalesce(own, F.lit(-1 << 63)).alias("id"), F.xxhash64(own.isNull(), text).alias("th"), text.alias("text"))


def _with_leaves(lines: DataFrame) -> DataFrame:
    """Adds hashes of the line's leaves; a line of one token has none, as nothing would be fixed in them."""
    n = F.octet_length("mask") - F.octet_length(F.replace("mask", F.lit(" "), F.lit(""))) + 1
    # columns of their own, as the optimizer would find the tokens again for each use
    found = lines.withColumn("n", n).withColumn("head", F.split(F.substring_index("mask", " ", LEADING), " "))
    pairs = [(a, b) for a in range(LEADING) for b in range(a + 1, LEADING)]
    leaves = F.array(*[F.xxhash64(F.lit(k), "n", F.get("head", F.lit(a)), F.get("head", F.lit(b))) for k, (a, b) in enumerate(pairs, 1)])
    return found.withColumn("leaves", F.when(F.col("n") > 1, leaves).otherwise(F.array().cast("array<long>"))).drop("n", "head")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> tuple[DataFrame, DataFrame]:
    """Two tables: of documents (id, th) and the numbers of their lines to drop, and of the templates with their number of documents."""
    texts = _texts(docs, id_col, text_col)
    lines = texts.select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line")).where("line <> ''").select("id", "th", "no", "line", masked(F.col("line")).alias("mask"))
    lines = _with_leaves(lines).select("id", "th", "no", F.xxhash64(F.lit(0), "line").alias("raw"), F.xxhash64(F.lit(7), "mask").alias("print"), "leaves")
    lines = materialize(lines)

    # different lines, and the leaves that are large enough; numbers of lines are no less than those of documents
    different = materialize(lines.groupBy("raw", "print").agg(F.count("*").alias("n"), F.first("leaves").alias("leaves"), F.min(F.struct("id", "th", "no")).alias("seen")))
    in_leaf = different.select("raw", "print", "n", F.explode("leaves").alias("leaf"))
    # a table of its own, as Spark only sees then how few they are, and need not move all lines to join them
    crowded = materialize(in_leaf.groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    chosen = in_leaf.join(crowded, "leaf").select("raw", "leaf", "print")
    whole = different.where(F.col("n") >= min_docs).select("raw", F.col("raw").alias("leaf"), F.col("raw").alias("print"))
    # a table of its own, so that Spark can split a line that a third of all documents have
    places = materialize(chosen.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True))).groupBy("raw").agg(F.collect_list(F.struct("leaf", "print", "whole")).alias("at")))

    # what each document has in each leaf, once
    held = lines.select("id", "th", "no", "raw").join(places, "raw").select("id", "th", "no", F.explode("at").alias("at")).select("id", "th", "no", "at.*")
    held = held.repartition("leaf", "id", "th").groupBy("whole", "leaf", "print", "id", "th").agg(F.collect_list("no").alias("nos"))
    held = materialize(held.withColumn("kinds", F.count("*").over(Window.partitionBy("leaf", "id", "th"))))
    discard(lines)
    alone = materialize(held.groupBy("whole", "leaf", "print").agg(F.count_if(F.col("kinds") == 1).alias("docs")))
    several = materialize(held.where("not whole and kinds > 1").select("leaf", "print", "id", "th"))

    # one line of each print is read again for its tokens
    prints = alone.where("not whole").select("leaf", "print", "docs")
    seen = different.join(prints.select("print").distinct(), "print", "left_semi").groupBy("print").agg(F.min("seen").alias("seen"))
    wanted = seen.groupBy("seen.id", "seen.th").agg(F.collect_list(F.struct("seen.no", "print")).alias("which"))
    found = texts.join(wanted.hint("shuffle_hash"), ["id", "th"]).select(F.split("text", "\n").alias("all"), F.explode("which").alias("w"))
    found = found.select("w.print", masked(F.element_at("all", F.col("w.no") + 1)).alias("line")).dropDuplicates(["print"])
    tokens = materialize(prints.join(found, "print").select("leaf", "print", "docs", F.posexplode(F.split("line", " ")).alias("pos", "token")))
    discard(different)

    def support(rows: DataFrame, *what: str) -> DataFrame:
        """Those of the things in rows (leaf, print, docs, what) that min_docs documents have, with their number."""
        one_by_one = rows.select("leaf", "print", *what).join(several, ["leaf", "print"]).select("leaf", *what, "id", "th").distinct().groupBy("leaf", *what).agg(F.count("*").alias("docs"))
        both = rows.groupBy("leaf", *what).agg(F.sum("docs").alias("docs")).unionByName(one_by_one)
        return both.groupBy("leaf", *what).agg(F.sum("docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)

    fixed = materialize(support(tokens.where(F.col("token") != WILD), "pos", "token").select("leaf", "pos", "token", F.lit(1).alias("fixed")))
    parts = tokens.join(fixed, ["leaf", "pos", "token"], "left").select("leaf", "print", "docs", "pos", "fixed", F.when(F.col("fixed") == 1, F.col("token")).otherwise(WILD).alias("token"))
    template = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    templates = materialize(parts.groupBy("leaf", "print").agg(F.max("docs").alias("docs"), template.alias("template"), F.avg(F.coalesce("fixed", F.lit(0))).alias("share")).where(F.col("share") >= constant))
    often = materialize(support(templates, "template"))
    gone = templates.join(often, ["leaf", "template"]).select("leaf", "print").unionByName(alone.where("whole").where(F.col("docs") >= min_docs).select("leaf", "print"))
    drop = held.join(gone, ["leaf", "print"]).groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("nos"))).alias("gone"))
    return drop, often.select("template", "n_docs")


def _joined(docs: DataFrame, extra: list[Column], id_col: str, text_col: str, min_docs: int, constant: float) -> DataFrame:
    drop, _ = recurring_lines(docs, id_col, text_col, min_docs, constant)
    both = _texts(docs, id_col, text_col, *extra).join(materialize(drop).hint("shuffle_hash"), ["id", "th"], "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return both.withColumn("kept_text", kept).withColumn("n_dropped", F.coalesce(F.size("gone"), F.lit(0)).cast("long")).withColumn("n_lines", F.size("lines").cast("long"))


@releasing
def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256 (of the lines that stay, joined by newlines).

    Lines are what stands between newlines, tokens what stands between spaces. Empty lines are never dropped. Null texts count as
    empty (one empty line), null ids are ids like any other, repeated rows are one document, an empty table gives no rows.
    """
    out = _joined(docs, [F.col(f"`{id_col}`").cast("long").alias("doc_id")], id_col, text_col, min_docs, constant)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@releasing
def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """docs without the recurring lines; null texts stay null."""
    out = _joined(docs, [same_columns(docs)], id_col, text_col, min_docs, constant)
    new = F.when(F.col("_row").getField(text_col).isNotNull(), F.col("kept_text"))
    return unpack(out.select(F.col("_row").withField(f"`{text_col}`", new).alias("_row")), docs.columns)
