"""Nested JSON documents: bundles, the index, manifests and site maps, in and out."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolloom.functions.paths import file_stem
from symbolloom.schemas import BUNDLE, CATEGORIES, META, SOURCE


def read_manifest(spark: SparkSession, text: str) -> DataFrame:
    """One row (meta, source) of a TOML manifest. Raises for a git source without repository or patterns."""
    doc = tomllib.loads(text)
    source = doc["source"]
    if source["type"] not in ("git", "direct"):
        raise ValueError("source.type is neither git nor direct")
    if source["type"] == "git":
        for field in ("repository", "patterns"):
            if source.get(field) is None:
                raise ValueError(f"a git source needs {field}")
    pick = lambda d, *names: tuple(d.get(n) for n in names)
    return spark.createDataFrame([(pick(doc["meta"], "name", "description", "author"), pick(source, "type", "merge", "repository", "endpoints", "patterns"))], f"meta {META}, source {SOURCE}")


def parse_bundles(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """``bodies`` with ``bundle``, the typed document; null for bodies that are no JSON. Unknown keys are passed over."""
    return bodies.withColumn("bundle", F.from_json(F.col(body_col), BUNDLE))


#: The maps of members of each category, by the members' kind.
MEMBERS = {"methodmaps": {"method": "methods", "property": "properties"}, "enumstructs": {"method": "methods", "field": "fields"}, "enums": {"entry": "entries"}, "typesets": {"type": "types"}}
_FIELDS = {"kind": ("kind",), "type": ("returnType", "type"), "value": ("value",), "parent": ("parent",)}


def document_symbols(typed: DataFrame, id_col: str) -> DataFrame:
    """(id_col, strand, category, name, member_kind, member, kind, type, value, parent) of documents from ``parse_bundles``.

    One row per symbol of every category, with null member_kind and member, and one per member. type is the
    return type of functions and methods; what a category doesn't have is null.
    """
    strands = typed.select(id_col, F.explode("bundle.strands").alias("strand", "s"))
    row = "array<struct<category:string,name:string,member_kind:string,member:string,kind:string,type:string,value:string,parent:string>>"
    fields_of = lambda t: {f.name for f in t.fields}
    maps = strands.schema["s"].dataType

    def one(names: set[str], category: str, name: Column, kind: Column, member: Column, value: Column) -> Column:
        held = [next((value[n] for n in inner if n in names), F.lit(None)).cast("string").alias(out) for out, inner in _FIELDS.items()]
        return F.struct(F.lit(category).alias("category"), name.alias("name"), kind.alias("member_kind"), member.alias("member"), *held)

    def of(category: str) -> Column:
        symbol = maps[category].dataType.valueType

        def rows(e: Column) -> Column:
            none = F.lit(None).cast("string")
            parts = [F.array(one(fields_of(symbol), category, e["key"], none, none, e["value"])).cast(row)]
            for kind, name in MEMBERS.get(category, {}).items():
                inner = fields_of(symbol[name].dataType.valueType)
                members = F.transform(F.map_entries(e["value"][name]), lambda m: one(inner, category, e["key"], F.lit(kind), m["key"], m["value"]))  # noqa: B023
                parts.append(F.coalesce(members.cast(row), F.array().cast(row)))
            return F.concat(*parts)

        return F.coalesce(F.flatten(F.transform(F.map_entries(F.col("s")[category]), rows)), F.array().cast(row))

    return strands.select(id_col, "strand", F.explode(F.concat(*map(of, CATEGORIES))).alias("r")).select(id_col, "strand", "r.*")


def search_symbols(typed: DataFrame, id_col: str) -> DataFrame:
    """Symbols of documents from ``parse_bundles`` in the shape that search takes: id_col, strand, category, name, return_type, arguments, members.

    Functions have their own return type and arguments, type definitions those of their parsed signature, and
    so do the members of type sets.
    """
    strands = typed.select(id_col, F.explode("bundle.strands").alias("strand", "s"))
    args = "array<struct<type:string,name:string>>"
    row = f"array<struct<category:string,name:string,return_type:string,arguments:{args},members:array<struct<kind:string,name:string,return_type:string,arguments:{args}>>>>"
    member_row = row[row.index("members:") + 8 : -2]
    maps = strands.schema["s"].dataType

    def signature(names: set[str], value: Column) -> tuple[Column, Column]:
        of = value["parsedSignature"] if "parsedSignature" in names else value if "arguments" in names else None
        if of is None:
            return F.lit(None).cast("string"), F.lit(None).cast(args)
        return of["returnType"], F.transform(of["arguments"], lambda a: F.struct(a["type"].alias("type"), a["name"].alias("name"))).cast(args)

    def member(kind: str, names: set[str]):
        def one(m: Column) -> Column:
            result, arguments = signature(names, m["value"])
            return F.struct(F.lit(kind).alias("kind"), m["key"].alias("name"), result.alias("return_type"), arguments.alias("arguments"))

        return one

    def of(category: str) -> Column:
        symbol = maps[category].dataType.valueType
        names = {f.name for f in symbol.fields}

        def rows(e: Column) -> Column:
            held = F.array().cast(member_row)
            for kind, name in MEMBERS.get(category, {}).items():
                inner = {f.name for f in symbol[name].dataType.valueType.fields}
                held = F.concat(held, F.coalesce(F.transform(F.map_entries(e["value"][name]), member(kind, inner)).cast(member_row), F.array().cast(member_row)))
            result, arguments = signature(names, e["value"])
            return F.struct(F.lit(category).alias("category"), e["key"].alias("name"), result.alias("return_type"), arguments.alias("arguments"), held.alias("members"))

        return F.coalesce(F.transform(F.map_entries(F.col("s")[category]), rows).cast(row), F.array().cast(row))

    return strands.select(id_col, "strand", F.explode(F.concat(*map(of, CATEGORIES))).alias("r")).select(id_col, "strand", "r.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, meta, source, file_stem) of an index document, a JSON object keyed by bundle name; nothing if it is not valid."""
    entry = f"MAP<STRING, STRUCT<meta {META}, source {SOURCE}, file_stem STRING>>"
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.explode(F.from_json("value", entry)).alias("name", "e")).select("name", "e.*")


def index_document(index: DataFrame) -> DataFrame:
    """(value): the index as one JSON object, names in order. For a document that is written whole: one row per bundle."""
    return as_map(index, [], "name", F.struct("meta", "source", "file_stem"), "m").select(F.to_json("m").alias("value"))


def build_index(spark: SparkSession, folder: str, out: str, known: str | None = None) -> int:
    """Reads the ``*.bundle`` files of a folder into the index ``known`` and writes it to ``out`` if anything differs.

    Returns the number of new and changed bundles. Unreadable files and files without a name are passed over.
    """
    from symbolloom.operators import catalogue

    incoming = read_bundle_files(spark, folder).where("meta.name is not null").select(F.col("meta.name").alias("name"), "meta", "source", "file_stem")
    prior = read_index(spark, known) if known else incoming.where("false")
    merged = catalogue.upsert(prior, incoming)
    diffs = merged.where("status <> 'kept'").count()
    if diffs:
        index_document(merged).coalesce(1).write.mode("overwrite").text(out)
    return diffs


#: Fields of strand documents, in which symbols are lists.
_LISTS = "functions ARRAY<STRUCT<name STRING>>, methodmaps ARRAY<STRUCT<name STRING, methods ARRAY<STRUCT<name STRING>>, properties ARRAY<STRUCT<name STRING>>>>, enumstructs ARRAY<STRUCT<name STRING, methods ARRAY<STRUCT<name STRING>>, fields ARRAY<STRUCT<name STRING>>>>, constants ARRAY<STRUCT<name STRING>>, enums ARRAY<STRUCT<name STRING>>, typesets ARRAY<STRUCT<name STRING>>, typedefs ARRAY<STRUCT<name STRING>>"


def read_strands(spark: SparkSession, folder: str, skip: str = "include") -> tuple[DataFrame, DataFrame]:
    """(strands, symbols) of a folder with one JSON document per strand, named by its stem; the stem ``skip`` is left out.

    symbols: strand, category, name, members. A strand without symbols is still in strands.
    """
    text = spark.read.option("wholetext", "true").text(folder).select(file_stem(F.col("_metadata.file_name")).alias("strand"), F.from_json("value", _LISTS).alias("d")).where(F.col("strand") != skip)
    members = "array<struct<kind:string,name:string>>"

    def named(kind: str):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m["name"].alias("name"))

    def symbol(category: str):
        fields = MEMBERS[category] if category in ("methodmaps", "enumstructs") else {}

        def one(e: Column) -> Column:
            held = F.concat(F.array().cast(members), *(F.coalesce(F.transform(e[f], named(k)).cast(members), F.array().cast(members)) for k, f in fields.items()))
            return F.struct(F.lit(category).alias("category"), e["name"].alias("name"), held.alias("members"))

        return one

    none = F.array().cast(f"array<struct<category:string,name:string,members:{members}>>")
    parts = [F.coalesce(F.transform(F.col("d")[c], symbol(c)), none) for c in CATEGORIES if c != "defines"]
    return text.select("strand"), text.select("strand", F.explode(F.concat(*parts)).alias("r")).select("strand", "r.*")


def read_bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.bundle`` files of a folder: file_stem and the document's fields; unreadable ones have nulls."""
    text = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.bundle").text(folder)
    return text.select(file_stem(F.col("_metadata.file_name")).alias("file_stem"), F.from_json("value", BUNDLE).alias("b")).select("file_stem", "b.*")


def read_includes(spark: SparkSession, folder: str, glob: str = "*.inc") -> DataFrame:
    """(stem, content) of raw include files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(file_stem(F.col("path")).alias("stem"), "content")


def as_map(rows: DataFrame, group: list[str], key: str, value: Column, name: str) -> DataFrame:
    """One row per group with a map from key to value; of equal keys the highest value's row holds, as maps take no duplicates.

    Only for documents that are written whole: a group becomes one value.
    """
    one = rows.groupBy(*group, key).agg(F.max(value).alias("__v")) if group else rows.select(key, value.alias("__v")).dropDuplicates([key])
    return one.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), "__v")))).alias(name))


def symbols_document(symbols: DataFrame, payload: Column | None = None) -> DataFrame:
    """(bundle, json): flat symbols nested as strand, category, name; for the document sink. ``payload``: what a symbol holds."""
    if payload is None:
        payload = F.struct("name", F.col("return_type").alias("returnType"), "kind", "parent", "arguments")
    names = as_map(symbols, ["bundle", "strand", "category"], "name", payload, "names")
    cats = names.groupBy("bundle", "strand").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.to_json("names").alias("j"))))).alias("c"))
    inner = cats.select("bundle", "strand", F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("c"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}")).alias("j"))
    key = F.expr("substring(to_json(named_struct('k', strand)), 6, length(to_json(named_struct('k', strand))) - 6)")
    out = inner.groupBy("bundle").agg(F.array_join(F.array_sort(F.collect_list(F.concat(key, F.lit(":"), "j"))), ",").alias("s"))
    return out.select("bundle", F.concat(F.lit('{"strands":{'), "s", F.lit("}}")).alias("json"))


def write_bundle(symbols: DataFrame, about: DataFrame, version: Column, path: str) -> None:
    """Writes the document of one bundle: meta and source (the row of ``about``), strands and version.

    ``symbols``: bundle, strand, category, name, docs, kind, return_type, parent, arguments, ref_line, doc_start,
    doc_end, created, last_updated. Without symbols the document has no strands.
    """
    stamps = F.struct("created", "last_updated").alias("metadata")
    payload = F.struct("name", F.col("ref_line").alias("refLine"), F.col("doc_start").alias("docStart"), F.col("doc_end").alias("docEnd"), "docs", stamps, "kind", F.col("return_type").alias("returnType"), "parent", "arguments")
    strands = symbols_document(symbols, payload).select(F.expr("substring(json, 12, length(json) - 12)").alias("strands"))
    whole = about.join(strands, F.lit(True), "left")  # one row each
    parts = [F.lit('{"meta":'), F.to_json("meta"), F.lit(',"source":'), F.to_json("source"), F.lit(',"strands":'), F.coalesce("strands", F.lit("{}")), F.lit(',"version":'), F.to_json(version), F.lit("}")]
    whole.select(F.concat(*parts).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_if_changed(rows: DataFrame, path: str, diffs: int) -> bool:
    """Writes one JSON-lines file if there are differences; tells whether it did."""
    if diffs <= 0:
        return False
    rows.coalesce(1).write.mode("overwrite").json(path)
    return True


def write_sitemap(pages: DataFrame, path: str) -> None:
    """XML of (loc, changefreq) pages."""
    pages.coalesce(1).write.mode("overwrite").format("xml").option("rowTag", "url").option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').option("declaration", 'version="1.0" encoding="UTF-8"').save(path)
