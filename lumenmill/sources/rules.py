"""Rule documents: folders of indented key-value files and Markdown as rows, and their trees as rows of paths.

A file is one row; its lines are gone through once, with the open keys as a stack, so the tree of a file is built where the file was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The folders of rules, in order.
RULE_FOLDERS = ("rules", "ai_noise_rules", "material_rules", "visual_style_rules")
# Fixed values end.

_LINE = "array<struct<n: int, indent: int, item: boolean, key: string, value: string>>"
_STACK = "array<struct<indent: int, path: string, items: int>>"
_OUT = "array<struct<n: int, path: string, value: string>>"


def read_rules(spark: SparkSession, root: str, folders: tuple[str, ...] = RULE_FOLDERS) -> DataFrame:
    """(category, place, path, file_type, text): the yaml, yml and md files of the folders under root, not of their subfolders; folders that are not there have none.

    place numbers the folders in their order; files of a folder go by name.
    """
    there = lambda path: path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    paths = [f"{root}/{f}" for f in folders if there(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{f}"))]
    if not paths:
        return spark.createDataFrame([], "category string, place int, path string, file_type string, text string")
    rows = spark.read.option("pathGlobFilter", "*.{yaml,yml,md,YAML,YML,MD}").option("recursiveFileLookup", False).text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    category = F.element_at(F.split("path", "/"), -2)
    kind = F.when(F.lower("path").endswith(".md"), "md").otherwise("yaml")
    return rows.select(category.alias("category"), F.array_position(F.lit(list(folders)), category).cast("int").alias("place"), "path", kind.alias("file_type"), "text")


def lines_of(text: Column) -> Column:
    """The lines of an indented text that count: not blank, no comment, without white space at their end; (n, indent, item, key, value)."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda s, n: F.struct(n.cast("int").alias("n"), F.rtrim(F.regexp_replace(s, r"\s+$", "")).alias("line")))
    lines = F.filter(lines, lambda s: (F.trim(s["line"]) != "") & ~F.ltrim(s["line"]).startswith("#"))

    def parts(s: Column) -> Column:
        bare = F.ltrim(s["line"])
        item = bare.startswith("- ")
        colon = F.instr(bare, ":")
        key = F.when(~item & (colon > 0), F.trim(F.substring(bare, F.lit(1), colon - 1)))
        value = F.when(item, F.trim(F.substring(bare, F.lit(3), F.length(bare)))).when(colon > 0, F.trim(F.substring(bare, colon + 1, F.length(bare))))
        return F.struct(s["n"].alias("n"), (F.length(s["line"]) - F.length(bare)).alias("indent"), item.alias("item"), key.alias("key"), value.alias("value"))

    return F.filter(F.transform(lines, parts), lambda s: s["item"] | s["key"].isNotNull()).cast(_LINE)


def tree_of(text: Column) -> Column:
    """The lines of an indented text with their paths in order: array of (n, path, value).

    A line belongs to the nearest one before it that is indented less. Keys are joined by dots; items of a list are numbered from 0, and
    a list at the top is called items.
    """
    root = F.array(F.struct(F.lit(-1).alias("indent"), F.lit("").alias("path"), F.lit(0).alias("items"))).cast(_STACK)
    start = F.struct(root.alias("stack"), F.array().cast(_OUT).alias("out"))

    def step(state: Column, line: Column) -> Column:
        open_ = F.filter(state["stack"], lambda e: e["indent"] < line["indent"])
        parent = F.element_at(open_, -1)
        name = F.when(line["item"], parent["items"].cast("string")).otherwise(line["key"])
        base = F.when((parent["path"] == "") & line["item"], F.lit("items")).otherwise(parent["path"])
        path = F.when(base == "", name).otherwise(F.concat(base, F.lit("."), name))
        counted = F.concat(F.slice(open_, F.lit(1), F.size(open_) - 1), F.array(F.struct(parent["indent"].alias("indent"), parent["path"].alias("path"), (parent["items"] + 1).alias("items"))))
        stack = F.concat(F.when(line["item"], counted).otherwise(open_), F.array(F.struct(line["indent"].alias("indent"), path.alias("path"), F.lit(0).alias("items"))))
        out = F.concat(state["out"], F.array(F.struct(line["n"].alias("n"), path.alias("path"), line["value"].alias("value"))))
        return F.struct(stack.cast(_STACK).alias("stack"), out.cast(_OUT).alias("out"))

    return F.aggregate(lines_of(text), start, step, lambda state: state["out"])


def value_kind(value: Column) -> Column:
    """What a plain value is: bool, null, string (quoted or not), int or float."""
    quoted = (F.length(value) >= 2) & value.rlike(r"""^(".*"|'.*')$""")
    return (
        F.when(value.isin("true", "True", "false", "False"), "bool").when(value.isin("null", "None", "~"), "null").when(quoted, "string")
        .when(value.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), "int").when(value.rlike(r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"), "float").otherwise("string")
    )


def rule_values(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row a value of their trees: n (line), rule_path, value (quotes taken off) and kind. A key without a value and without lines below it is an empty map; keys with lines below give no row."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, tree_of(F.coalesce(F.col(text), F.lit(""))).alias("tree"))
    nodes = F.transform("tree", lambda e, i: F.struct(e["n"].alias("n"), e["path"].alias("path"), e["value"].alias("value"), F.coalesce(F.get(F.col("tree"), i + 1)["path"].startswith(F.concat(e["path"], F.lit("."))), F.lit(False)).alias("above")))
    rows = rows.select(*keep, F.explode(nodes).alias("e")).where("NOT (e.above AND e.value = '')")
    v = F.col("e.value")
    plain = F.when((F.length(v) >= 2) & v.rlike(r"""^(".*"|'.*')$"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return rows.select(*keep, F.col("e.n").alias("n"), F.col("e.path").alias("rule_path"), F.when(v == "", "{}").otherwise(plain).alias("value"), F.when(v == "", "map").otherwise(value_kind(v)).alias("kind"))


def headings(text: Column) -> Column:
    """The headings of a Markdown text: its lines that begin with #, without these."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: s.startswith("#"))
    return F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"^[# ]+|[# ]+$", "")))


def token_hits(docs: DataFrame, groups: list[tuple[str, ...]], text: str = "text") -> list[bool]:
    """For each group of tokens whether any text has one of them: one row of flags, whatever the number of documents."""
    has = [F.coalesce(F.bool_or(F.greatest(*[F.col(text).contains(t) for t in (*g, g[0])])), F.lit(False)).alias(f"g{i}") for i, g in enumerate(groups)]
    return list(docs.agg(*has).first())
