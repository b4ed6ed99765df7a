"""The queries of the operator inventory, with their SQL where DuckDB can express them over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolloom.functions import docs, paths, scoring, signature
from symbolloom.operators import catalogue, merge, nested, search
from symbolloom.operators.snapshot_diff import symbol_attributes
from symbolloom.parser.declarations import parse_files
from symbolloom.plans import generate
from symbolloom.schemas import VERSION
from symbolloom.session import table
from symbolloom.sources import bundles

NEEDLES = ["almond antique", "BLUSH", "chiffon burnish", "light", "", "x", "steel  blue"]
NEEDLE = "Hook"
DOCUMENT_NEEDLE = "index"
PATTERNS = ["*.inc", "scripting/*.sp"]
BASE_URL = "https://docs.example.org/#"


def _last_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of every strand's last snapshot; of a key that occurs twice the one declared last."""
    rows = table(spark, sf, "snapshots").where("bundle is not null and strand is not null and version.count is not null")
    last = rows.groupBy("bundle", "strand").agg(F.max("version.count").alias("last"))
    rows = rows.join(last, ["bundle", "strand"]).where("version.count = last")
    held = rows.groupBy("bundle", "strand", "category", "name").agg(F.max_by(F.struct("return_type", "arguments", "members", "parent", "kind", "docs"), "decl_ord").alias("r"))
    return held.select("bundle", "strand", "category", "name", "r.*")


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of every strand's last snapshot, in the shape that search takes."""
    held = _last_rows(spark, sf)
    members = F.transform("members", lambda m: F.struct(m["kind"].alias("kind"), m["name"].alias("name"), F.when(m["kind"] == "method", m["detail"]).alias("return_type"), F.lit(None).cast("array<struct<type:string,name:string>>").alias("arguments")))
    arguments = F.transform("arguments", lambda a: F.struct(a["type"].alias("type"), a["name"].alias("name")))
    return held.select("bundle", "strand", "category", "name", "return_type", arguments.alias("arguments"), members.alias("members"), "kind", "parent")


def parsed_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every strand's last snapshot written as a source file and parsed again: functions, method maps and enums with all they hold."""
    held = _last_rows(spark, sf).withColumn("result", F.when(F.col("return_type").isin("native", "forward", "stock"), "int").otherwise(F.col("return_type")))
    comment = F.concat(F.lit("/**\n * "), F.col("docs.brief"), F.array_join(F.transform(F.coalesce("docs.tags", F.array()), lambda t: F.concat(F.lit("\n * @"), t["tag"], F.lit(" "), t["text"])), ""), F.lit("\n */\n"))
    arguments = F.array_join(F.transform("arguments", lambda a: F.concat(a["decl"], F.coalesce(F.concat(F.lit(" = "), a["default"]), F.lit("")))), ", ")
    body = F.when(F.col("kind").isin("native", "forward"), ";\n").otherwise("\n{\n\treturn 0; // nothing\n}\n")
    function = F.concat("kind", F.lit(" "), "result", F.lit(" "), "name", F.lit("("), arguments, F.lit(")"), body)
    kind_of = lambda d: F.when(d.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), d).otherwise("int")  # noqa: E731  some details are no types
    member = lambda m: F.when(m["kind"] == "method", F.concat(F.lit("\tpublic native "), kind_of(m["detail"]), F.lit(" "), m["name"], F.lit("();\n"))).otherwise(F.concat(F.lit("\tproperty "), kind_of(m["detail"]), F.lit(" "), m["name"], F.lit(" {\n\t\tpublic native get();\n\t}\n")))
    methodmap = F.concat(F.lit("methodmap "), "name", F.coalesce(F.concat(F.lit(" < "), "parent"), F.lit("")), F.lit("\n{\n"), F.array_join(F.transform("members", member), ""), F.lit("}\n"))
    enum = F.concat(F.lit("enum "), "name", F.lit(" {\n"), F.array_join(F.transform("members", lambda m: F.concat(F.lit("\t"), m["name"], F.coalesce(F.concat(F.lit(" = "), m["detail"]), F.lit("")), F.lit(",\n"))), ""), F.lit("}\n"))
    text = F.concat(F.lit("\n"), F.coalesce(comment, F.lit("")), F.when(F.col("category") == "functions", function).when(F.col("category") == "methodmaps", methodmap).otherwise(enum))
    files = held.select("bundle", "strand", F.struct("category", "name", text.alias("text")).alias("t")).groupBy("bundle", "strand").agg(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), ""), "utf-8").alias("content"))
    out = parse_files(files, ["bundle", "strand"]).where("error is null")
    named = F.array_join(F.transform("arguments", lambda a: F.concat_ws(" ", a["type"], a["name"], a["default"])), ";")
    held_members = F.array_join(F.array_sort(F.array_distinct(F.transform("members", lambda m: F.concat_ws(" ", m["kind"], m["name"], m["type"], m["value"])))), ";")
    pick = lambda c, v: F.when(F.col("category") == c, v)
    brief = docs.parse_comment(F.col("doc_text"))["brief"]
    return out.select("bundle", "strand", "category", "name", pick("functions", F.col("kind")).alias("kind"), pick("functions", F.col("return_type")).alias("return_type"), pick("methodmaps", F.col("parent")).alias("parent"), pick("functions", named).alias("arguments"), F.when(F.col("category") != "functions", held_members).alias("members"), brief.alias("brief"))


def parsed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Enum structs, constants, defines, type sets and type definitions of the documents, written as source files and parsed again."""
    typed = bundles.parse_bundles(table(spark, sf, "bundle_files").select("file_id", "body"))
    rows = bundles.document_symbols(typed, "file_id").where(F.col("category").isin("enumstructs", "constants", "defines", "typesets", "typedefs"))
    word, signature = "^[A-Za-z_][A-Za-z0-9_]*$", r"^function .*\(.*\)$"
    member = F.when(F.col("member").isNotNull(), F.struct("member_kind", "member", F.when(F.col("type").rlike(word), F.col("type")).otherwise("int").alias("type")))
    own = F.max(F.when(F.col("member").isNull(), F.struct("type", "value"))).alias("own")
    held = rows.groupBy("file_id", "strand", "category", "name").agg(own, F.array_sort(F.collect_set(member)).alias("members"))
    line = lambda m: F.when(m["member_kind"] == "field", F.concat(F.lit("\t"), m["type"], F.lit(" "), m["member"], F.lit(";\n"))).when(m["member_kind"] == "method", F.concat(F.lit("\t"), m["type"], F.lit(" "), m["member"], F.lit("()\n\t{\n\t}\n"))).otherwise(F.concat(F.lit("\t"), m["member"], F.lit(";\n")))
    body = F.array_join(F.transform("members", line), "")
    kind = F.when(F.col("own.type").rlike(signature), F.col("own.type")).otherwise("function void ()")
    text = (
        F.when(F.col("category") == "enumstructs", F.concat(F.lit("enum struct "), "name", F.lit("\n{\n"), body, F.lit("}\n"))).when(F.col("category") == "constants", F.concat(F.lit("enum\n{\n\t"), "name", F.lit("\n};\n")))
        .when(F.col("category") == "defines", F.concat(F.lit("#define "), "name", F.lit(" "), F.coalesce("own.value", F.lit("")), F.lit("\n"))).when(F.col("category") == "typesets", F.concat(F.lit("typeset "), "name", F.lit("\n{\n"), body, F.lit("}\n")))
        .otherwise(F.concat(F.lit("typedef "), "name", F.lit(" = "), kind, F.lit(";\n")))
    )
    files = held.select("file_id", "strand", F.struct("category", "name", text.alias("text")).alias("t")).groupBy("file_id", "strand").agg(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "\n"), "utf-8").alias("content"))
    out = parse_files(files, ["file_id", "strand"]).where("error is null")
    members = F.array_join(F.array_sort(F.transform("members", lambda m: F.concat_ws(" ", m["kind"], m["name"], F.when(m["kind"] != "type", m["type"])))), ";")
    return out.select("file_id", "strand", "category", "name", F.when(F.col("category") == "typedefs", F.col("type")).alias("type"), F.when(F.col("category") == "defines", F.coalesce("value", F.lit(""))).alias("value"), F.when(F.col("category").isin("enumstructs", "typesets"), members).alias("members"))


def _held(spark: SparkSession, sf: str) -> DataFrame:
    return merge.held_rows(table(spark, sf, "snapshots"), symbol_attributes(), ["members", "ref_line"])


def _flat(df: DataFrame) -> DataFrame:
    """Paths as text, scores rounded, so that results compare as values."""
    return df.select("bundle", "name", "identifier", "part", F.array_join("path", "/").alias("path"), F.round("score", 9).alias("score"))


def _document_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of all categories of the typed documents, in the shape that search takes; the file is the bundle."""
    typed = bundles.parse_bundles(table(spark, sf, "bundle_files").select(F.col("file_id").cast("string").alias("file"), "body"))
    return bundles.search_symbols(typed, "file").withColumnRenamed("file", "bundle")


def score_names(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    rows = names.select("name", F.explode(F.array(*map(F.lit, NEEDLES))).alias("needle"))
    return rows.withColumn("score", F.round(scoring.score(F.col("name"), F.col("needle")), 9))


def search_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.search(_symbols(spark, sf), NEEDLE))


def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The search over documents, where symbols of all categories and methods with arguments occur."""
    return _flat(search.search(_document_symbols(spark, sf), DOCUMENT_NEEDLE))


def search_l1only(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.search(_symbols(spark, sf), NEEDLE, weighted=False, l1_only=True))


def search_top(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.ranked(search.search(_symbols(spark, sf), NEEDLE).dropDuplicates(["bundle", "path", "part", "name"]), 20))


def recent_additions(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols that exist after their last update: a deletion is an update like any other."""
    rows = table(spark, sf, "symbol_updates")
    held = rows.groupBy("bundle", "strand", "category", "name").agg(F.max_by(F.struct("created", "is_deleted"), F.struct("last_updated.count", "received_at", "update_id")).alias("r"))
    held = held.where(~F.coalesce("r.is_deleted", F.lit(False))).select("bundle", "strand", "category", "name", "r.created")
    return search.recent_additions(held).select("bundle", "strand", "category", "name", F.col("created.count").alias("created_count"))


def recent_members(spark: SparkSession, sf: str) -> DataFrame:
    """Recent additions of the merged snapshots, fed by symbols and by methods, whose stamp is their parent's."""
    merged = merge.merge(_held(spark, sf))
    members = F.transform("payload.members", lambda m: F.struct(m["kind"].alias("kind"), m["name"].alias("name"), F.col("last_updated").alias("created")))
    feed = search.recent_feed(merged.select(*merge.KEY, "created", F.array_distinct(members).alias("members")))
    return search.recent_additions(feed).select(*merge.KEY, "member", F.col("created.count").alias("created_count"))


def path_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every path of a search result, as it is, normalised, and with a part without a dot in between, looked up in its own bundle."""
    symbols = _symbols(spark, sf)
    asked = search.result_rows(symbols).select("bundle", "path").distinct()
    normal = asked.select("bundle", paths.normalize_path(F.col("path")).alias("path"))
    plain = asked.select("bundle", F.concat(F.slice("path", 1, 1), F.array(F.lit("plain")), F.slice("path", 2, 9)).alias("path"))
    found = search.lookup(symbols, asked.unionByName(normal).unionByName(plain).distinct())
    return found.select("bundle", F.array_join("path", "/").alias("path"), "found_category", "found_name", "found_member")


def path_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.result_rows(_symbols(spark, sf)).select("path").distinct()
    return rows.select(F.array_join("path", "/").alias("path"), F.array_join(paths.normalize_path(F.col("path")), "/").alias("normal"), paths.split_path(F.get("path", 1))["identifier"].alias("identifier"))


def strand_is_empty(spark: SparkSession, sf: str) -> DataFrame:
    flat = nested.flatten(table(spark, sf, "bundle_files"), levels=("strand", "symbol"), with_text=False).withColumn("bundle", F.col("file_id"))
    out = search.empty_strands(flat.where("level = 'strand'"), flat.where("level = 'symbol'"))
    return out.select(F.col("bundle").alias("file_id"), "strand", "is_empty")


def commit_number(spark: SparkSession, sf: str) -> DataFrame:
    numbered = search.number_commits(table(spark, sf, "commits").dropDuplicates(["bundle", "commit_hash"]))
    return numbered.where("parent_count = 1").select("bundle", "commit_hash", "ordinal")


def resume_commits(spark: SparkSession, sf: str) -> DataFrame:
    commits = table(spark, sf, "commits").select("bundle", "commit_hash", "rev_count", "rev_time", "parent_count").distinct()
    last = table(spark, sf, "deliveries").groupBy("bundle").agg(F.max("version.time").alias("rev_time"), F.max("version.count").alias("rev_count"))
    return merge.resume_commits(commits, last).select("bundle", "commit_hash")


def version_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = merge.merge(_held(spark, sf))
    return out.select("bundle", "strand", "category", "name", F.col("created.count").alias("created"), F.col("last_updated.count").alias("last_updated"), F.col("payload.ref_line").alias("ref_line"))


def version_merge_members(spark: SparkSession, sf: str) -> DataFrame:
    out = merge.member_stamps(merge.merge(_held(spark, sf)))
    return out.select("bundle", "strand", "category", "name", "member_kind", "member", F.col("created.count").alias("created"), F.col("last_updated.count").alias("last_updated"))


def merge_diff_count(spark: SparkSession, sf: str) -> DataFrame:
    return merge.diff_count(_held(spark, sf))


def merge_resume(spark: SparkSession, sf: str) -> DataFrame:
    """The merge of each strand's earlier half of snapshots, resumed with the rest; equals version_merge."""
    held = _held(spark, sf)
    middle = held.groupBy("bundle", "strand").agg(((F.min("rev") + F.max("rev")) / 2).alias("middle"))
    held = held.join(middle, ["bundle", "strand"])
    prior = merge.merge(held.where("rev <= middle").drop("middle"))
    out = merge.merge(held.where("rev > middle").drop("middle"), prior)
    return out.select("bundle", "strand", "category", "name", F.col("created.count").alias("created"), F.col("last_updated.count").alias("last_updated"), F.col("payload.ref_line").alias("ref_line"))


def key_diff(spark: SparkSession, sf: str) -> DataFrame:
    """New, deleted and changed keys of every snapshot against the strand's snapshot before it."""
    rows = _held(spark, sf)
    strand = Window.partitionBy(*merge.STRAND).orderBy("rev")
    revs = rows.select(*merge.STRAND, "rev").distinct()
    revs = revs.select(*merge.STRAND, "rev", F.lag("rev").over(strand).alias("prev"), F.lead("rev").over(strand).alias("next"))
    rows = rows.join(revs, [*merge.STRAND, "rev"])
    old = rows.where("next is not null").withColumn("rev", F.col("next"))
    return merge.key_diff(old, rows.where("prev is not null"), [*merge.KEY, "rev"], "h")


def retain_strands(spark: SparkSession, sf: str) -> DataFrame:
    symbols = table(spark, sf, "symbol_updates").select("bundle", "strand", "category", "name").distinct()
    return merge.retain(symbols, table(spark, sf, "deliveries"))


def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The whole index comes in; known before were all its rows, some under another name, some with another description."""
    rows = table(spark, sf, "bundle_index")
    n = F.length("name")
    prior = rows.withColumn("meta", F.when(n % 4 == 0, F.struct(F.col("meta.name").alias("name"), F.lit("old").alias("description"), F.col("meta.author").alias("author"))).otherwise(F.col("meta")))
    prior = prior.withColumn("name", F.when(n % 3 == 0, F.concat("name", F.lit("_gone"))).otherwise(F.col("name")))
    out = catalogue.upsert(prior, rows.withColumn("file_stem", F.concat("file_stem", F.lit("2"))))
    return out.select("name", F.col("meta.description").alias("description"), "file_stem", "status")


def source_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The index, and each of its rows again with an unknown type, without type, repository and patterns."""
    rows = table(spark, sf, "bundle_index")
    none = F.lit(None).cast("string")
    damage = {"odd": {"type": F.lit("svn")}, "untyped": {"type": none}, "git": {"type": F.lit("git"), "repository": none}, "bare": {"type": F.lit("git"), "patterns": F.lit(None).cast("array<string>")}, "direct": {"type": F.lit("direct"), "repository": none}}
    out = rows.select("name", "source")
    for label, fields in damage.items():
        source = F.col("source")
        for f, v in fields.items():
            source = source.withField(f, v)
        out = out.unionByName(rows.select(F.concat("name", F.lit("/" + label)).alias("name"), source.alias("source")))
    return catalogue.invalid_sources(out)


def keyby_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", F.col("ts").cast("string").alias("t"))
    return search.last_wins(rows, ["user_id", "event_type"], ["t", "event_id"]).select("user_id", "event_type", "event_id", "value")


def comment_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as declarations on every second line, each with a comment that ends before it, on it, or starts on it."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("bigint").alias("n"), "l_partkey", "l_suppkey")
    decls = rows.select("file", (F.col("n") * 2).alias("line"), "l_partkey")
    begin = F.col("n") * 2 - F.col("l_suppkey") % 3
    comments = rows.select("file", begin.alias("start_line"), F.greatest(begin, F.col("n") * 2 - 1 + F.col("l_suppkey") % 2).alias("end_line"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey")).alias("end"))
    return search.attach_comments(decls, comments).select("file", "line", "l_partkey", "doc_start", "doc_end")


def text_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Each text's bytes from the second on, cut at eighths of its byte length; null where a cut splits a character.

    The first byte is left out in slice 0, as a start of 0 means that there is no slice (``doc_slice``).
    """
    rows = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    at = lambda k: F.floor(F.octet_length("b") * k / 8)
    return rows.select("doc_id", "k", docs.doc_slice(F.col("b"), F.greatest(at(F.col("k")), F.lit(1)), at(F.col("k") + 1)).alias("piece"))


def signature_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("function "), F.col("p_brand"), F.lit(" (const "), F.regexp_replace("p_type", " ", "_"), F.lit("[] x, "), F.split("p_name", " ")[0], F.lit(" "), F.col("p_size").cast("string"), F.lit(", ...)")).alias("s"))
    got = rows.select("p_partkey", signature.parse_signature(F.col("s")).alias("g"))
    return got.select("p_partkey", F.col("g.returnType").alias("return_type"), F.size("g.arguments").cast("bigint").alias("n"), F.get("g.arguments", 0)["type"].alias("type0"), F.get("g.arguments", 0)["name"].alias("name0"), F.get("g.arguments", 1)["name"].alias("name1"))


def file_stems(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("path", r"\\", "/")
    return table(spark, sf, "blobs").select("blob_id", paths.file_stem(path).alias("stem"), paths.glob_match(path, PATTERNS).alias("matches"))


def sitemap_urls(spark: SparkSession, sf: str) -> DataFrame:
    return search.sitemap(_symbols(spark, sf), BASE_URL)


def parse_includes(spark: SparkSession, sf: str) -> DataFrame:
    symbols = generate.symbols_of(generate.file_versions(table(spark, sf, "blobs")))
    return symbols.select("bundle", "strand", F.col("version.count").alias("rev"), "category", "name", "kind", "return_type", F.size("arguments").alias("n_arguments"), "ref_line", F.col("docs.brief").alias("brief"))


def unreadable_includes(spark: SparkSession, sf: str) -> DataFrame:
    """File versions that give no symbols as they can't be read."""
    return generate.failures_of(generate.file_versions(table(spark, sf, "blobs"))).select("bundle", "strand", F.col("version.count").alias("rev"))


def generate_history(spark: SparkSession, sf: str) -> DataFrame:
    out = generate.generate(generate.file_versions(table(spark, sf, "blobs")), payload=["ref_line"])
    return out.select("bundle", "strand", "category", "name", F.col("created.count").alias("created"), F.col("last_updated.count").alias("last_updated"))


def bundle_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Version of each bundle: that of its last snapshot, whatever became of it."""
    rows = table(spark, sf, "deliveries").where("version is not null")
    return rows.groupBy("bundle").agg(F.max_by(F.col("version").cast(VERSION), "version.count").alias("v")).select("bundle", F.col("v.hash").alias("hash"), F.col("v.count").alias("count"))


def bundle_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of all categories of the typed documents, and their members."""
    return bundles.document_symbols(bundles.parse_bundles(table(spark, sf, "bundle_files").select("file_id", "body")), "file_id")


def symbol_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of bundles' documents, written whole and read again."""
    written = bundles.symbols_document(_symbols(spark, sf)).withColumnRenamed("bundle", "owner").withColumnRenamed("json", "body")
    read = bundles.document_symbols(bundles.parse_bundles(written), "owner")
    return read.select(F.col("owner").alias("bundle"), "strand", "category", "name", "kind", "type", "parent")


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of pages that hold the whole text, without its angle brackets, as title and again as body."""
    text = F.translate("text", "<>", "")
    page = F.concat(F.lit("<html><head><TITLE> "), text, F.lit("</TITLE></head><body>"), text, F.lit("</body></html>"))
    return table(spark, sf, "documents").select("doc_id", docs.page_title(page).alias("title"))


_QUERIES = (
    score_names, search_weighted, search_l1only, search_top, recent_additions, path_lookup, path_normalize, strand_is_empty, commit_number, resume_commits, version_merge, version_merge_members,
    merge_diff_count, merge_resume, recent_members, search_documents, key_diff, retain_strands, index_upsert, source_checks, keyby_last_wins, comment_attach, text_slices, signature_parse, file_stems, sitemap_urls, parse_includes, unreadable_includes, parsed_sources, parsed_documents,
    generate_history, bundle_versions, bundle_symbols, symbol_documents, page_texts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_BLANK = r"[\s\x0B\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _score(a: str, b: str) -> str:
    """SQL of the score; a and b are columns."""
    s1, s2 = (f"regexp_replace({x}, '{_BLANK}', '', 'g')" for x in (a, b))
    grams = lambda s: f"list_transform(range(1, length({s})::bigint), lambda k: substr({s}, k, 2))"
    inter = f"coalesce(list_sum(list_transform(list_distinct({grams(s1)}), lambda z: least(len(list_filter({grams(s1)}, lambda x: x = z)), len(list_filter({grams(s2)}, lambda x: x = z))))), 0)"
    return f"(case when {a} is null or {b} is null then null when {a} = {b} then 1.0 when lower({a}) = lower({b}) then 0.9 when contains(lower({a}), lower({b})) then 0.8 when {s1} = {s2} then 1.0 when length({s1}) < 2 or length({s2}) < 2 then 0.0 else 2.0::double * {inter} / (length({s1}) + length({s2}) - 2) end)::double"


_SYMBOLS = """
    rows_ as (select * from snapshots where bundle is not null and strand is not null and version.count is not null),
    last_ as (select bundle, strand, max(version.count) as last from rows_ group by all),
    symbols as (
        select r.* from rows_ r join last_ l on l.bundle = r.bundle and l.strand = r.strand and r.version.count = l.last
        qualify row_number() over (partition by r.bundle, r.strand, r.category, r.name order by r.decl_ord desc) = 1)"""

_ROWS = f"""{_SYMBOLS},
    found as (
        select bundle, strand, category, name, case category when 'functions' then 'function' when 'methodmaps' then 'methodmap' else 'enumeration' end as id,
               case category when 'methodmaps' then 0.05 when 'functions' then 0.02 else 0.03 end::double as w, return_type, arguments, members from symbols),
    result as (
        select bundle, strand, name, id as identifier, 0 as part, strand || '/' || id || '.' || name as path, name as sought, case when category = 'functions' then 0.0 else 0.01 end::double as bonus, w, 1 as l1 from found
        union all select bundle, strand, a.type, id, 1, strand || '/' || id || '.' || name || '/argument.' || a.name, a.type, 0.0, w, 1 from (select *, unnest(arguments) as a from found where category = 'functions')
        union all select bundle, strand, return_type, id, 2, strand || '/' || id || '.' || name || '/return.' || return_type, return_type, 0.0, w, 1 from found where category = 'functions' and return_type is not null
        union all select bundle, strand, m.name, mid, 0, strand || '/' || id || '.' || name || '/' || mid || '.' || m.name, m.name, 0.0, w, 0 from (
            select *, case when category = 'enums' and m.kind = 'entry' then 'enumeration_entry' when category = 'methodmaps' and m.kind = 'method' then 'methodmap_method' when category = 'methodmaps' and m.kind = 'property' then 'methodmap_property' end as mid
            from (select *, unnest(members) as m from found)) where mid is not null
        union all select bundle, strand, m.detail, 'methodmap_method', 2, strand || '/' || id || '.' || name || '/methodmap_method.' || m.name || '/return.' || m.detail, m.detail, 0.0, w, 0 from (select *, unnest(members) as m from found where category = 'methodmaps') where m.kind = 'method' and m.detail is not null)"""

_HELD = """
    held as (
        select bundle, strand, category, name, version.count as rev, ref_line, members,
               struct_pack(a := docs, b := kind, c := return_type, d := parent, e := arguments, f := list_sort(list_distinct(members))) as s
        from snapshots where bundle is not null and strand is not null and version.count is not null
        qualify row_number() over (partition by bundle, strand, version.count, category, name order by decl_ord desc nulls last) = 1),
    revs as (
        select *, row_number() over (partition by bundle, strand order by rev) as seq, count(*) over (partition by bundle, strand) as n
        from (select distinct bundle, strand, rev from held)),
    steps as (
        select h.*, r.seq, r.n, lag(r.seq) over w as pseq, lag(h.s) over w as ps from held h join revs r using (bundle, strand, rev)
        window w as (partition by bundle, strand, category, name order by r.seq)),
    marks as (select *, pseq is null or pseq <> seq - 1 as is_new, pseq = seq - 1 and s is distinct from ps as is_upd from steps),
    lives as (select *, sum(is_new::int) over (partition by bundle, strand, category, name order by seq) as life from marks),
    merged as (
        select bundle, strand, category, name, min(rev) as created, max(rev) filter (is_new or is_upd) as last_updated,
               arg_max(ref_line, seq) filter (is_new or is_upd) as ref_line, arg_max(members, seq) filter (is_new or is_upd) as members
        from lives group by bundle, strand, category, name, life, n having max(seq) = n)"""

_NORMAL = "case {} when 'enumeration_entry' then 'entry' when 'methodmap_method' then 'function' when 'enumstruct_method' then 'function' when 'methodmap_property' then 'property' when 'enumstruct_field' then 'field' else {} end"
_NORMAL_PATH = "list_transform(string_split(path, '/'), lambda p: case when contains(p, '.') then " + _NORMAL.format("string_split(p, '.')[1]", "string_split(p, '.')[1]") + " || '.' || string_split(p, '.')[2] else p end)"


_CATEGORIES_SQL = "('functions', 'function', 0.02, 0.0), ('methodmaps', 'methodmap', 0.05, 0.01), ('enumstructs', 'enumstruct', 0.05, 0.01), ('constants', 'constant', 0.0, 0.0), ('defines', 'define', 0.0, 0.0), ('enums', 'enumeration', 0.03, 0.01), ('typesets', 'typeset', 0.03, 0.0), ('typedefs', 'typedef', 0.03, 0.0)"


def oracle_sql() -> dict[str, str]:
    needles = ", ".join(f"'{n}'" for n in NEEDLES)
    score = _score("sought", f"'{NEEDLE}'")
    return {
        "score_names": f"select name, needle, round({_score('name', 'needle')}, 9) as score from (select distinct p_name as name, unnest([{needles}]) as needle from part)",
        "search_weighted": f"with {_ROWS} select bundle, name, identifier, part, path, round(v, 9) as score from (select *, {score} + bonus + w as v from result) where v > 0.5",
        "search_l1only": f"with {_ROWS} select bundle, name, identifier, part, path, round(v, 9) as score from (select *, {score} + bonus as v from result where l1 = 1) where v > 0.5",
        "search_top": f"with {_ROWS} select bundle, name, identifier, part, path, round(v, 9) as score from (select *, {score} + bonus + w as v from result qualify row_number() over (partition by bundle, path, part, name) = 1) where v > 0.5 order by v desc, bundle, path, part, name limit 20",
        "recent_additions": """
            with held as (select * from symbol_updates qualify row_number() over (partition by bundle, strand, category, name order by last_updated.count desc nulls last, received_at desc, update_id desc) = 1)
            select bundle, strand, category, name, created.count as created_count from held where created.count is not null and is_deleted is not true
            order by created.count desc, list_position(['functions', 'methodmaps', 'enumstructs', 'constants', 'defines', 'enums', 'typesets', 'typedefs'], category), bundle, strand, name limit 20""",
        "recent_members": f"""
            with {_HELD}, feed as (
                select bundle, strand, category, name, null as member, created as created_count from merged
                union all select distinct bundle, strand, category, name, m.name, last_updated from (select *, unnest(members) as m from merged) where m.kind = 'method')
            select * from feed order by created_count desc, list_position(['functions', 'methodmaps', 'enumstructs', 'constants', 'defines', 'enums', 'typesets', 'typedefs'], category), bundle, strand, name, member nulls first limit 20""",
        "path_normalize": f"with {_ROWS} select distinct path, array_to_string({_NORMAL_PATH}, '/') as normal, string_split(regexp_extract(path, '/((?:function|methodmap|enumeration)\\..*)$', 1), '.')[1] as identifier from result",
        "path_lookup": f"""
            with {_ROWS}, asked as (select distinct bundle, strand, substr(path, length(strand) + 2) as rest from result),
            every as (select bundle, strand, rest from asked union select bundle, strand, array_to_string(list_transform(string_split(rest, '/'), lambda p: case when contains(p, '.') then {_NORMAL.format("string_split(p, '.')[1]", "string_split(p, '.')[1]")} || '.' || string_split(p, '.')[2] else p end), '/') from asked
                      union select bundle, strand, 'plain/' || rest from asked),
            kept as (select *, list_filter(string_split(rest, '/')[1:2], lambda p: contains(p, '.')) as ps from every),
            parts as (select *, string_split(ps[1], '.') as a, string_split(ps[2], '.') as b from kept),
            want as (select *, case a[1] when 'function' then 'functions' when 'methodmap' then 'methodmaps' when 'enumeration' then 'enums' else 'typedefs' end as category, a[2] as name, b[2] as m,
                     case when b[1] in ('methodmap_method', 'function') then 'method' when b[1] in ('enumstruct_field', 'field') then 'field' else 'property' end as k from parts)
            select w.bundle, w.strand || '/' || w.rest as path, k.category as found_category, k.name as found_name, case when w.category = 'methodmaps' and list_contains(list_transform(k.members, lambda x: x.kind || ':' || x.name), w.k || ':' || w.m) then w.m end as found_member
            from want w left join symbols k on k.bundle = w.bundle and k.strand = w.strand and k.category = w.category and k.name = w.name""",
        "search_documents": f"""
            with docs as (select file_id::varchar as bundle, json(body) as j from bundle_files where json_valid(body)),
            strands as (select bundle, k as strand, json_extract(j, '$.strands."' || k || '"') as j from (select bundle, j, unnest(json_keys(j, '$.strands')) as k from docs where json_type(j, '$.strands') = 'OBJECT')),
            cats as (select bundle, strand, c as category, i as id, x.w, x.o, json_extract(j, '$.' || c) as j from strands, (values {_CATEGORIES_SQL}) x(c, i, w, o)),
            syms as (select bundle, strand, category, id, w, o, k as name, json_extract(j, '$."' || k || '"') as v from (select *, unnest(json_keys(j)) as k from cats where json_type(j) = 'OBJECT')),
            top as (select *, strand || '/' || id || '.' || name as path, case when category = 'functions' then v when category = 'typedefs' then json_extract(v, '$.parsedSignature') end as sig from syms),
            mems as (select t.*, f, k as m, json_extract(j, '$."' || k || '"') as mv from (
                select t.*, f, json_extract(v, '$.' || f) as j, unnest(json_keys(v, '$.' || f)) as k from top t, (values ('methodmaps', 'methods'), ('methodmaps', 'properties'), ('enumstructs', 'methods'), ('enumstructs', 'fields'), ('enums', 'entries'), ('typesets', 'types')) z(c, f)
                where c = category and json_type(v, '$.' || f) = 'OBJECT') t),
            named as (select *, case when f = 'entries' then 'enumeration_entry' when f = 'types' then null when category = 'methodmaps' then case f when 'methods' then 'methodmap_method' else 'methodmap_property' end else case f when 'methods' then 'enumstruct_method' else 'enumstruct_field' end end as mid from mems),
            called as (
                select bundle, w, path, case when category = 'functions' then 'function' else 'argument' end as aid, case when category = 'functions' then 'function' else 'return' end as rid, false as shows_name, path as rpath, sig from top where sig is not null
                union all select bundle, w, path || '/' || mid || '.' || m, mid, mid, false, path || '/' || mid || '.' || m, mv from named where f = 'methods'
                union all select bundle, w, path || '/entry.' || m, 'argument', 'return', true, path, json_extract(mv, '$.parsedSignature') from named where f = 'types'),
            args as (select *, unnest(from_json(json_extract(sig, '$.arguments'), '["json"]')) as a from called where json_type(sig, '$.arguments') = 'ARRAY'),
            result as (
                select bundle, name, id as identifier, 0 as part, path, name as sought, o as bonus, w from top
                union all select bundle, m, mid, 0, path || '/' || mid || '.' || m, m, 0.0, w from named where mid is not null
                union all select bundle, case when shows_name then a->>'name' else a->>'type' end, aid, 1, path || '/argument.' || (a->>'name'), a->>'type', 0.0, w from args
                union all select bundle, sig->>'returnType', rid, 2, rpath || '/return.' || (sig->>'returnType'), sig->>'returnType', 0.0, w from called where sig->>'returnType' is not null)
            select bundle, name, identifier, part, path, round(v, 9) as score from (select *, {_score("sought", f"'{DOCUMENT_NEEDLE}'")} + bonus + w as v from result) where v > 0.5""",
        "bundle_symbols": """
            with docs as (select file_id, json(body) as j from bundle_files where json_valid(body)),
            strands as (select file_id, k as strand, json_extract(j, '$.strands."' || k || '"') as j from (select file_id, j, unnest(json_keys(j, '$.strands')) as k from docs where json_type(j, '$.strands') = 'OBJECT')),
            cats as (select file_id, strand, c as category, json_extract(j, '$.' || c) as j from strands, unnest(['functions', 'methodmaps', 'enumstructs', 'constants', 'defines', 'enums', 'typesets', 'typedefs']) t(c)),
            syms as (select file_id, strand, category, k as name, json_extract(j, '$."' || k || '"') as v from (select *, unnest(json_keys(j)) as k from cats where json_type(j) = 'OBJECT')),
            held as (select s.*, kd as member_kind, json_extract(v, '$.' || f) as j from syms s, (values ('methodmaps', 'method', 'methods'), ('methodmaps', 'property', 'properties'), ('enumstructs', 'method', 'methods'), ('enumstructs', 'field', 'fields'), ('enums', 'entry', 'entries'), ('typesets', 'type', 'types')) t(c, kd, f) where c = category),
            mems as (select file_id, strand, category, name, member_kind, k as member, json_extract(j, '$."' || k || '"') as v from (select *, unnest(json_keys(j)) as k from held where json_type(j) = 'OBJECT')),
            every as (select file_id, strand, category, name, null as member_kind, null as member, v from syms union all select * from mems)
            select file_id, strand, category, name, member_kind, member, case when category = 'functions' or member_kind = 'method' then v->>'kind' end as kind,
                   case when category = 'functions' or member_kind = 'method' then v->>'returnType' when category = 'typedefs' or member_kind in ('property', 'field', 'type') then v->>'type' end as type,
                   case when category = 'defines' or member_kind = 'entry' then v->>'value' end as value, case when category = 'methodmaps' and member_kind is null then v->>'parent' end as parent from every""",
        "unreadable_includes": r"""
            with rows_ as (
                select repo as bundle, regexp_replace(string_split(replace(path, chr(92), '/'), '/')[-1], '(.)\.[^.]*$', '\1') as strand, rev_count as rev, replace(path, chr(92), '/') as p, content
                from blobs where repo is not null and content is not null and regexp_matches(lower(path), '\.(inc|sp)$')),
            held as (select * from rows_ qualify row_number() over (partition by bundle, strand, rev order by p desc, sha256(content) desc) = 1)
            select bundle, strand, rev from held where contains(hex(content), '00') and regexp_matches(hex(content), '^(..)*00') or not regexp_full_match(hex(content),
              '([0-7].|(C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|(E[1-9A-CEF])[89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[1-3][89AB].[89AB].[89AB].|F48.[89AB].[89AB].)*')""",
        "parsed_documents": r"""
            with docs as (select file_id, json(body) as j from bundle_files where json_valid(body)),
            strands as (select file_id, k as strand, json_extract(j, '$.strands."' || k || '"') as j from (select file_id, j, unnest(json_keys(j, '$.strands')) as k from docs where json_type(j, '$.strands') = 'OBJECT')),
            cats as (select file_id, strand, c as category, json_extract(j, '$.' || c) as j from strands, unnest(['functions', 'methodmaps', 'enumstructs', 'constants', 'defines', 'enums', 'typesets', 'typedefs']) t(c)),
            syms as (select file_id, strand, category, k as name, json_extract(j, '$."' || k || '"') as v from (select *, unnest(json_keys(j)) as k from cats where json_type(j) = 'OBJECT')),
            held as (select s.*, kd as member_kind, json_extract(v, '$.' || f) as j from syms s, (values ('methodmaps', 'method', 'methods'), ('methodmaps', 'property', 'properties'), ('enumstructs', 'method', 'methods'), ('enumstructs', 'field', 'fields'), ('enums', 'entry', 'entries'), ('typesets', 'type', 'types')) t(c, kd, f) where c = category),
            mems as (select file_id, strand, category, name, member_kind, k as member, json_extract(j, '$."' || k || '"') as v from (select *, unnest(json_keys(j)) as k from held where json_type(j) = 'OBJECT')),
            every as (select file_id, strand, category, name, null as member_kind, null as member, v from syms union all select * from mems),
            said as (
                select *, case member_kind when 'type' then 'type ' || member else member_kind || ' ' || member || ' ' || case when regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*') then t else 'int' end end as m
                from (select *, case when member_kind = 'method' then v->>'returnType' else v->>'type' end as t from every where category in ('enumstructs', 'constants', 'defines', 'typesets', 'typedefs')))
            select file_id, strand, category, name, max(case when category = 'typedefs' then case when regexp_matches(t, '^function .*\(.*\)$') then t else 'function void ()' end end) as type,
                   max(case when category = 'defines' then coalesce(trim(v->>'value'), '') end) as value,
                   case when category in ('enumstructs', 'typesets') then coalesce(array_to_string(list_sort(list(m) filter (m is not null)), ';'), '') end as members
            from said group by file_id, strand, category, name""",
        "parsed_sources": f"""
            with {_SYMBOLS}, said as (
                select *, list_transform(arguments, lambda a: a.type || ' ' || a.name || coalesce(' ' || case when a."default" = '(1 << 3)' then '1 << 3' when a."default" = '{{0, 0, 0}}' then '{{ 0, 0, 0 }}' when a."default" = '0.0' then '0.000000' else a."default" end, '')) as args,
                       list_sort(list_distinct(list_transform(members, lambda m: m.kind || ' ' || m.name || coalesce(' ' || case when m.kind <> 'entry' then case when regexp_full_match(m.detail, '[A-Za-z_][A-Za-z0-9_]*') then m.detail else 'int' end when regexp_full_match(m.detail, '[0-9]+[.][0-9]+') then format('{{:f}}', m.detail::double) else trim(m.detail, '()') end, '')))) as held from symbols)
            select bundle, strand, category, name, case when category = 'functions' then kind end as kind, case when category = 'functions' then case when return_type in ('native', 'forward', 'stock') then 'int' else return_type end end as return_type,
                   case when category = 'methodmaps' then parent end as parent, case when category = 'functions' then array_to_string(args, ';') end as arguments, case when category <> 'functions' then array_to_string(held, ';') end as members,
                   trim(regexp_replace(docs.brief, '\\s+', ' ', 'g')) as brief from said""",
        "symbol_documents": f"""
            with {_SYMBOLS} select bundle, strand, category, name, case when category = 'functions' then kind end as kind, case when category = 'functions' then return_type end as type,
                   case when category = 'methodmaps' then parent end as parent from symbols""",
        "strand_is_empty": """
            with docs as (select file_id, json(body) as j from bundle_files where json_valid(body)),
            strands as (select file_id, k as strand, json_extract(j, '$.strands."' || k || '"') as j from (select file_id, j, unnest(json_keys(j, '$.strands')) as k from docs where json_type(j, '$.strands') = 'OBJECT')),
            counts as (select file_id, strand, sum(len(json_keys(j, '$.' || c))) as n from strands, unnest(['functions', 'methodmaps', 'enumstructs', 'constants', 'enums', 'typesets', 'typedefs']) t(c) where json_type(j, '$.' || c) = 'OBJECT' group by all)
            select s.file_id, s.strand, coalesce(c.n, 0) = 0 as is_empty from strands s left join counts c using (file_id, strand)""",
        "commit_number": """
            with c as (select distinct bundle, commit_hash, rev_count, rev_time, parent_count from commits),
            n as (select *, (row_number() over (partition by bundle order by rev_time, rev_count, commit_hash) - 1)::int as ordinal from c)
            select bundle, commit_hash, ordinal from n where parent_count = 1""",
        "resume_commits": """
            with last as (select bundle, max(version.time) as t from deliveries group by bundle)
            select distinct c.bundle, c.commit_hash from commits c left join last l using (bundle) where c.parent_count = 1 and (l.t is null or c.rev_time >= l.t)""",
        "version_merge": f"with {_HELD} select bundle, strand, category, name, created, last_updated, ref_line from merged",
        "version_merge_members": f"with {_HELD} select distinct bundle, strand, category, name, m.kind as member_kind, m.name as member, last_updated as created, last_updated from (select *, unnest(members) as m from merged)",
        "merge_diff_count": f"with {_HELD} select (select count(*) from (select distinct bundle, strand from held)) + (select count(*) from marks where is_upd) as diffs",
        "merge_resume": f"with {_HELD} select bundle, strand, category, name, created, last_updated, ref_line from merged",
        "key_diff": f"""
            with {_HELD}, near as (select *, lag(rev) over w as prev, lead(rev) over w as next from (select distinct bundle, strand, rev from held) window w as (partition by bundle, strand order by rev)),
            n as (select h.*, r.prev from held h join near r using (bundle, strand, rev) where r.prev is not null),
            o as (select h.* exclude (rev), r.next as rev from held h join near r using (bundle, strand, rev) where r.next is not null)
            select coalesce(n.bundle, o.bundle) as bundle, coalesce(n.strand, o.strand) as strand, coalesce(n.category, o.category) as category, coalesce(n.name, o.name) as name, coalesce(n.rev, o.rev) as rev,
                   case when o.bundle is null then 'new' when n.bundle is null then 'deleted' else 'changed' end as change
            from o full join n on o.bundle = n.bundle and o.strand = n.strand and o.rev = n.rev and o.category is not distinct from n.category and o.name is not distinct from n.name where o.bundle is null or n.bundle is null or o.s is distinct from n.s""",
        "retain_strands": "select distinct bundle, strand, category, name from symbol_updates u where exists (select 1 from deliveries d where d.bundle = u.bundle and d.strand = u.strand)",
        "index_upsert": """
            with p as (select case when length(name) % 3 = 0 then name || '_gone' else name end as name, case when length(name) % 4 = 0 then 'old' else meta.description end as d, file_stem as f from bundle_index),
            i as (select name, meta.description as d, file_stem || '2' as f from bundle_index)
            select coalesce(p.name, i.name) as name, case when p.name is null or (i.name is not null and p.d is distinct from i.d) then i.d else p.d end as description,
                   case when p.name is null or (i.name is not null and p.d is distinct from i.d) then i.f else p.f end as file_stem,
                   case when p.name is null then 'new' when i.name is null or p.d is not distinct from i.d then 'kept' else 'changed' end as status
            from p full join i on p.name = i.name""",
        "source_checks": """
            with s as (select name, source.type as t, source.repository as r, source.patterns as p from bundle_index),
            every as (select * from s union all select name || '/odd', 'svn', r, p from s union all select name || '/untyped', null, r, p from s union all select name || '/git', 'git', null, p from s
                      union all select name || '/bare', 'git', r, null from s union all select name || '/direct', 'direct', null, p from s)
            select name, case when t is null or t not in ('git', 'direct') then 'type' when r is null then 'repository' else 'patterns' end as problem
            from every where t is null or t not in ('git', 'direct') or (t = 'git' and (r is null or p is null))""",
        "keyby_last_wins": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
        "comment_attach": """
            with r as (select l_orderkey as file, l_linenumber::bigint as n, l_partkey, l_suppkey from lineitem),
            c as (select file, n * 2 - l_suppkey % 3 as a, greatest(n * 2 - l_suppkey % 3, n * 2 - 1 + l_suppkey % 2) as b, l_partkey as s, l_partkey + l_suppkey as e from r),
            lead_ as (select file, b + 1 as line, min(struct_pack(s := s, e := e)) as c from c group by all), tail_ as (select file, a as line, min(struct_pack(s := s, e := e)) as c from c group by all)
            select r.file, r.n * 2 as line, r.l_partkey, coalesce(l.c.s, t.c.s, 0) as doc_start, coalesce(l.c.e, t.c.e, 0) as doc_end
            from r left join lead_ l on l.file = r.file and l.line = r.n * 2 left join tail_ t on t.file = r.file and t.line = r.n * 2""",
        "text_slices": """
            with d as (select doc_id, hex(encode(text)) as h, unnest(range(8))::int as k from documents),
            cuts as (select *, greatest((length(h) // 2) * k // 8, 1) as a, (length(h) // 2) * (k + 1) // 8 as b from d),
            edges as (select *, substr(h, 2 * a + 1, 1) as x, substr(h, 2 * b + 1, 1) as y from cuts)
            select doc_id, k, case when h is null or b = 0 then null when b <= a then '' when x not in ('8', '9', 'A', 'B') and y not in ('8', '9', 'A', 'B') then decode(unhex(substr(h, 2 * a + 1, 2 * (b - a)))) end as piece from edges""",
        "page_texts": "select doc_id, nullif(trim(translate(text, '<>', ''), ' \t\n\r\f\v'), '') as title from documents",
        "signature_parse": "select p_partkey, p_brand as return_type, 2::bigint as n, 'const ' || replace(p_type, ' ', '_') || '[]' as type0, 'x' as name0, p_size::varchar as name1 from part",
        "file_stems": "select blob_id, regexp_replace(string_split(replace(path, '\\', '/'), '/')[-1], '(.)\\.[^.]*$', '\\1') as stem, regexp_matches(replace(path, '\\', '/'), '^.*\\.inc(/.*)?$') or regexp_matches(replace(path, '\\', '/'), '^scripting/.*\\.sp(/.*)?$') as matches from blobs",
        "sitemap_urls": f"""
            with {_SYMBOLS}, owned as (select strand, category, members, case category when 'functions' then 'function' when 'methodmaps' then 'methodmap' else 'enum' end || '.' || name as own from symbols),
            subs as (
                select distinct strand, '' as sub from symbols union all select strand, own from owned
                union all select strand, own || '/' || case m.kind when 'method' then 'function' else 'property' end || '.' || m.name from (select strand, own, unnest(members) as m from owned where category = 'methodmaps') where m.kind in ('method', 'property'))
            select '{BASE_URL}/' || strand || '/' || sub as loc, 'monthly' as changefreq from subs""",
        "bundle_versions": "select bundle, arg_max(version.hash, version.count) as hash, max(version.count) as count from deliveries where version is not null group by bundle",
    }
