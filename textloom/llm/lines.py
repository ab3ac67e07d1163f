"""Problem 3: lines repeated across the documents of one site.

Weighted graphs of consecutive lines: nodes are normalised lines of a site with the number of rows that hold them, edges are
nodes that follow each other in a row with the number of rows where they do. Nodes and edges of high support are kept; connected
components are boilerplate blocks; matching occurrences are deleted from the texts.

Defined cases: a null or empty text has no lines; a null url or one without a host belongs to no site and has no cases; a line
that is repeated inside one row counts once for support, and each occurrence is reported; extra columns pass through unharmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.strings import let
from textloom.session import cut

LEAST_ROWS = 8
LEAST_LETTERS = 15
SALTS = 8  # copies of labels that spread the nodes of a large component
HOT_PARTS = 4096  # a node with a share of rows above 1/HOT_PARTS is hot; there are at most HOT_PARTS times lines-per-row of them


def host(url: Column) -> Column:
    """Lower-cased host without port and leading "www."; null where there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/@?#]*@)?(?:www\.)?([^/:?#\s]+)", 1)
    return F.when(found != "", found)


def normal(line: Column) -> Column:
    """A line as it is compared: lower case, digit runs as one 0, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]+", " "))


def occurrences(rows: DataFrame, id_col: str = "rec_id", text_col: str = "text", url_col: str = "url", with_line: bool = False) -> DataFrame:
    """(id, line_no, node, check, next) of each line that counts. node and check are two hashes of site and line, next is the node
    of the next line of the row that counts, null for the last one. with_line adds site and line.

    Lines are normalised and joined with their successors inside the array, before it is exploded: the optimiser can't repeat the
    expressions, and no shuffle brings the lines of a row together again.
    """
    short = lambda x: (F.length(x) < LEAST_LETTERS) | x.rlike(r"^\s*#")
    counts = lambda x: x.isNotNull() & (F.length(x) >= LEAST_LETTERS) & ~F.startswith(x, F.lit("#")) & (F.length(F.regexp_replace(x, r"[^\p{L}]+", "")) >= LEAST_LETTERS)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), F.when(~short(x), normal(x)).alias("line")))
    counted = F.filter(lines, lambda s: counts(s["line"]))
    keyed = F.transform(counted, lambda s: F.struct(s["line_no"].alias("line_no"), F.xxhash64("site", s["line"]).alias("node"), F.hash(s["line"], "site").alias("check"), *([s["line"].alias("line")] if with_line else [])))

    def chained(a: Column) -> Column:
        following = F.concat(F.slice(a["node"], F.lit(2), F.size(a)), F.array(F.lit(None).cast("long")))
        return F.when(F.size(a) > 0, F.zip_with(a, following, lambda s, n: F.struct(s.alias("s"), n.alias("next"))))

    texts = rows.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("site"), F.col(text_col).alias("text")).where("site IS NOT NULL AND text IS NOT NULL AND text <> ''")
    extra = ["site"] if with_line else []
    return texts.select("id", *extra, F.explode(let(keyed, chained)).alias("o")).select("id", *extra, "o.s.*", "o.next")


def nodes(found: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """(node, check, support): lines in `least` rows of their site at least. A row counts once; its id spreads hot nodes."""
    per_row = found.groupBy("node", "check", "id").agg(F.lit(1).alias("one"))
    return per_row.groupBy("node", "check").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def kept_occurrences(found: DataFrame, kept: DataFrame, rows: int) -> DataFrame:
    """Occurrences of kept nodes. Hot nodes are joined by broadcast (their number is bounded), others by a shuffle."""
    bar = max(rows // HOT_PARTS, 1000)
    hot = kept.where(F.col("support") > bar)
    rest = kept.where(F.col("support") <= bar)
    return found.join(F.broadcast(hot), ["node", "check"]).unionByName(
        found.join(F.broadcast(hot.select("node", "check")), ["node", "check"], "left_anti").join(rest, ["node", "check"])
    )


def edges(repeated: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """(u, v, weight): different kept nodes that follow each other, as counted lines, in `least` rows."""
    per_row = repeated.where("next <> node").groupBy("node", "next", "id").agg(F.lit(1).alias("one"))
    return per_row.groupBy(F.col("node").alias("u"), F.col("next").alias("v")).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def components(linked: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, block): the smallest node of each node's connected component over edges (u, v).

    Labels spread to neighbours, then jump to the label of their label, until nothing changes; each round cuts its lineage in the
    shared folder. Labels that are roots need no jump, and the others are salted, so that the label of a giant component is no hot key.
    """
    both = cut(linked.select("u", "v").unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.select(F.col("u").alias("node")).distinct().withColumn("block", F.col("node")))
    if labels.isEmpty():
        return labels
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "block"), "v").groupBy(F.col("u").alias("node")).agg(F.min("block").alias("seen"))
        stepped = labels.join(near, "node").select("node", F.col("block").alias("was"), F.least("block", "seen").alias("block"), F.pmod(F.hash("node"), F.lit(SALTS)).alias("salt"))
        up = labels.where("node <> block").select(F.col("node").alias("block"), F.col("block").alias("far"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        jumped = stepped.join(up, ["block", "salt"], "left").select("node", "was", F.least("block", F.coalesce("far", "block")).alias("block"))
        done = cut(jumped)
        labels = done.select("node", "block")
        if done.where("was <> block").isEmpty():
            return labels
    raise RuntimeError("blocks did not settle; raise rounds")


def repeated_lines(rows: DataFrame, least: int = LEAST_ROWS, id_col: str = "rec_id", text_col: str = "text", url_col: str = "url", with_line: bool = False) -> DataFrame:
    """(id, line_no, node, check, next, support, block) of each occurrence of a line of a boilerplate block.

    The graph has the kept nodes and the kept edges between them; its components are the blocks, named by their smallest node. A
    kept node without kept edges is a block of its own. Texts are read once; the keys of their lines are written to the shared folder.
    """
    found = cut(occurrences(rows, id_col, text_col, url_col, with_line))
    kept = cut(nodes(found, least))
    n = found.select("id").agg(F.approx_count_distinct("id")).first()[0]
    linked = edges(kept_occurrences(found, kept, n), least)
    graph = cut(kept.join(components(linked), "node", "left").withColumn("block", F.coalesce("block", "node")))
    return kept_occurrences(found, graph, n)


def blocks(repeated: DataFrame) -> DataFrame:
    """(node, check, site, line, support, block, name): the lines of each block, from repeated_lines(with_line=True). name is the
    smallest site and line of the block, so that blocks can be compared without hashes."""
    lines = repeated.groupBy("node", "check").agg(F.min("site").alias("site"), F.min("line").alias("line"), F.first("support").alias("support"), F.first("block").alias("block"))
    names = lines.groupBy("block").agg(F.min(F.concat_ws(" ", "site", "line")).alias("name"))
    return lines.join(names, "block")


def without_repeated(rows: DataFrame, repeated: DataFrame, id_col: str = "rec_id", text_col: str = "text") -> DataFrame:
    """rows with `clean_text`: text without the repeated lines. Ids must be distinct; null text stays null."""
    drop = repeated.groupBy(F.col("id").alias("_drop_id")).agg(F.collect_set("line_no").alias("_drop"))
    lines = F.split(F.col(text_col), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_drop"), i)), "\n")
    return rows.join(drop, F.col(id_col) == F.col("_drop_id"), "left").withColumn("clean_text", F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(left)).drop("_drop_id", "_drop")
