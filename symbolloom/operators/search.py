"""Search, lookup, recent additions and site map over flat symbols.

Symbols: bundle, strand, category, name, return_type, arguments ARRAY<STRUCT<type, name>>, members
ARRAY<STRUCT<kind, name, return_type, arguments>>; other columns pass by. One scan expands a symbol into
its result rows, so every query is one narrow stage up to its final order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolloom.functions.paths import element
from symbolloom.functions.scoring import score
from symbolloom.schemas import CATEGORIES, DISPLAY, IDENTIFIER, MEMBER_IDENTIFIER, NAME, OWN_BONUS, PARAMETER, RETURN, WEIGHT

_ROW = "array<struct<name:string,identifier:string,part:int,path:array<string>,sought:string,bonus:double>>"


def _by(key: Column, values: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _row(name: Column, identifier: Column, part: int, path: Column, bonus: float | Column = 0.0, sought: Column | None = None) -> Column:
    b = F.lit(bonus) if isinstance(bonus, float) else bonus
    return F.struct(name.alias("name"), identifier.alias("identifier"), F.lit(part).alias("part"), path.alias("path"), (name if sought is None else sought).alias("sought"), b.alias("bonus"))


def _arguments(arguments: Column, identifier: Column, path: Column, shown: str = "type") -> Column:
    none = F.array().cast(_ROW)
    return F.coalesce(F.transform(arguments, lambda a: _row(a[shown], identifier, PARAMETER, F.concat(path, F.array(element(F.lit("argument"), a["name"]))), sought=a["type"])).cast(_ROW), none)


def _result(kind: Column, identifier: Column, path: Column) -> Column:
    return F.when(kind.isNotNull(), F.array(_row(kind, identifier, RETURN, F.concat(path, F.array(element(F.lit("return"), kind))))).cast(_ROW)).otherwise(F.array().cast(_ROW))


def result_rows(symbols: DataFrame, parents: list[str] | None = None, l1_only: bool = False) -> DataFrame:
    """All rows that a search scores: bundle, strand, category, name, identifier, part, path, sought, bonus, emission.

    Functions always give rows for arguments and the return type; the members of other categories only
    without ``l1_only``. Null arguments or members count as none. emission orders the rows of a strand.
    """
    identifier = _by(F.col("category"), IDENTIFIER, None)
    top = F.array(*map(F.lit, parents or []), F.col("strand"), element(identifier, F.col("name")))
    own = F.array(_row(F.col("name"), identifier, NAME, top, _by(F.col("category"), OWN_BONUS, 0.0))).cast(_ROW)
    none = F.array().cast(_ROW)
    called = F.concat(_arguments(F.col("arguments"), identifier, top), _result(F.col("return_type"), identifier, top))

    def member(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        for (category, k), v in MEMBER_IDENTIFIER.items():
            kind = F.when((F.col("category") == category) & (m["kind"] == k), v).otherwise(kind)
        path = F.concat(top, F.array(element(kind, m["name"])))
        rest = F.when(m["kind"] == "method", F.concat(_arguments(m["arguments"], kind, path), _result(m["return_type"], kind, path))).otherwise(none)
        type_path = F.concat(top, F.array(element(F.lit("entry"), m["name"])))
        of_type = F.concat(_arguments(m["arguments"], F.lit("argument"), type_path, "name"), _result(m["return_type"], F.lit("return"), top))
        return F.when(m["kind"] == "type", of_type).when(kind.isNotNull(), F.concat(F.array(_row(m["name"], kind, NAME, path)).cast(_ROW), rest)).otherwise(none)

    if l1_only:
        rows = F.when(F.col("category") == "functions", F.concat(own, called)).otherwise(own)
    else:
        signature = F.concat(_arguments(F.col("arguments"), F.lit("argument"), top), _result(F.col("return_type"), F.lit("return"), top))
        inner = F.coalesce(F.flatten(F.transform("members", member)), none)
        rows = F.when(F.col("category") == "functions", F.concat(own, called)).when(F.col("category") == "typedefs", F.concat(own, signature)).when(F.col("category").isin("constants", "defines"), own).otherwise(F.concat(own, inner))
    order = _by(F.col("category"), {c: i for i, c in enumerate(CATEGORIES)}, len(CATEGORIES))
    out = symbols.where(F.col("category").isin(CATEGORIES)).select("bundle", "strand", "category", F.col("name").alias("symbol"), order.alias("category_ord"), F.posexplode(rows).alias("row_ord", "r"))
    return out.select("bundle", "strand", "category", "symbol", "category_ord", "row_ord", "r.*")


def search(symbols: DataFrame, needle: str, weighted: bool = True, identifier: str | None = None, l1_only: bool = False, parents: list[str] | None = None) -> DataFrame:
    """(bundle, name, identifier, part, path, score) with a score above 0.5; unordered.

    Weights are added after scoring, before the filter. ``identifier`` relabels the argument and return
    rows of functions, it filters nothing. An empty needle is contained in every name.
    """
    rows = result_rows(symbols, parents, l1_only)
    if identifier:
        rows = rows.withColumn("identifier", F.when((F.col("category") == "functions") & (F.col("part") != NAME), F.lit(identifier)).otherwise(F.col("identifier")))
    total = score(F.col("sought"), needle) + F.col("bonus")
    if weighted:
        total = total + _by(F.col("category"), WEIGHT, 0.0)
    return rows.withColumn("score", total).where(F.col("score") > 0.5).select("bundle", "name", "identifier", "part", "path", "score")


def ranked(results: DataFrame, n: int | None = None) -> DataFrame:
    """Results by falling score; ties by bundle and path, so that the order is fixed. ``n``: a top-n report."""
    ordered = results.orderBy(F.desc("score"), "bundle", F.array_join("path", "/"), "part", "name")
    return ordered.limit(n) if n else ordered


def recent_feed(symbols: DataFrame) -> DataFrame:
    """What a search feeds to recent_additions(): symbols, and the methods among their members, with ``created``.

    A member without a created version of its own doesn't count; members need a field ``created`` for that.
    """
    cols = ["bundle", "strand", "category", "name", F.lit(None).cast("string").alias("member"), "created"]
    methods = symbols.select("bundle", "strand", "category", "name", F.explode(F.filter("members", lambda m: m["kind"] == "method")).alias("m"))
    return symbols.select(*cols).unionByName(methods.select("bundle", "strand", "category", "name", F.col("m.name").alias("member"), F.col("m.created").alias("created")))


def recent_additions(symbols: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` symbols with the highest created.count, in falling order; of ties those emitted first (category, bundle, strand, name, member).

    Symbols without a created version don't count. ``symbols`` holds what exists now: what was deleted last
    has to be left out before.
    """
    order = _by(F.col("category"), {c: i for i, c in enumerate(CATEGORIES)}, len(CATEGORIES))
    member = ["member"] if "member" in symbols.columns else []
    return symbols.where("created.count is not null").orderBy(F.desc("created.count"), order, "bundle", "strand", "name", *member).limit(n)


class Recents:
    """Recent additions that are fed batch by batch, until they are frozen; clearing them thaws them.

    At most ``n`` rows are held, so they live on the driver.
    """

    def __init__(self, n: int = 20) -> None:
        self.n, self.frozen, self.held = n, False, None

    def feed(self, symbols: DataFrame) -> None:
        if self.frozen:
            return
        spark = symbols.sparkSession
        known = [] if self.held is None else self.held
        both = symbols if not known else symbols.unionByName(spark.createDataFrame(known, symbols.schema))
        self.held = recent_additions(both, self.n).collect()

    def freeze(self, frozen: bool = True) -> None:
        """Stops feeding; ``frozen`` False clears what is held and starts again."""
        self.frozen = frozen
        if not frozen:
            self.held = None


def lookup(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """Symbols and members that paths name: ``paths`` has columns bundle and path (ARRAY<STRING>), of which three parts count.

    Part one is the strand. Of the two after it those without a dot are passed over, unless they are just
    ``entry`` or ``enumeration_entry``; the first one left is identifier.name, the next identifier.name of a
    method, field or property of a method map or enum struct. An unknown identifier means typedefs, or
    properties. Parts are cut at every dot, and only two pieces count. Adds found_category, found_name and
    found_member; paths that lead nowhere, and null ones, have nulls. A shuffle join on (bundle, strand,
    category, name); members are looked up within the row.
    """
    named = F.filter(F.slice("path", 2, 2), lambda p: F.contains(p, F.lit(".")) | p.isin("entry", "enumeration_entry"))
    wanted = paths.withColumn("__strand", F.get("path", 0)).withColumn("__rest", named)
    piece = lambda i, j: F.get(F.split(F.get("__rest", i), "[.]"), j)
    wanted = wanted.withColumn("__name", piece(0, 1)).withColumn("__category", _by(piece(0, 0), {v: k for k, v in IDENTIFIER.items()}, "typedefs"))
    kind = _by(piece(1, 0), {"methodmap_method": "method", "function": "method", "enumstruct_field": "field", "field": "field"}, "property")
    wanted = wanted.withColumn("__member", piece(1, 1)).withColumn("__kind", kind)
    pairs = F.transform("members", lambda m: F.struct(m["kind"].alias("kind"), m["name"].alias("name")))
    keys = {"__strand": "strand", "__category": "category", "__name": "name"}
    known = symbols.groupBy("bundle", *(F.col(c).alias(k) for k, c in keys.items())).agg(F.max(F.coalesce(pairs, F.array().cast("array<struct<kind:string,name:string>>"))).alias("__members"))
    joined = wanted.join(known, ["bundle", *keys], "left")
    asked = F.col("__category").isin("methodmaps", "enumstructs") & F.col("__member").isNotNull()
    hit = F.array_contains("__members", F.struct(F.col("__kind").alias("kind"), F.col("__member").alias("name")))
    there = F.col("__members").isNotNull()
    return joined.select(*paths.columns, F.when(there, F.col("__category")).alias("found_category"), F.when(there, F.col("__name")).alias("found_name"), F.when(asked & hit, F.col("__member")).alias("found_member"))


def empty_strands(strands: DataFrame, symbols: DataFrame) -> DataFrame:
    """(bundle, strand, is_empty) of each row of ``strands``: no symbols but defines, which may be include guards."""
    counts = symbols.where("category <> 'defines'").groupBy("bundle", "strand").agg(F.count(F.lit(1)).alias("n"))
    return strands.select("bundle", "strand").distinct().join(counts, ["bundle", "strand"], "left").select("bundle", "strand", F.col("n").isNull().alias("is_empty"))


def sitemap(symbols: DataFrame, base_url: str, fix_labels: bool = False, strands: DataFrame | None = None) -> DataFrame:
    """(loc, changefreq): a page for each strand and symbol, and below its owner's page for each method, property and field.

    Defines and enum entries have none. Enum structs are labelled as method maps, unless ``fix_labels``.
    ``strands`` (a column strand) adds strands that have no symbols. Null names have no page.
    """
    labels = DISPLAY | ({} if fix_labels else {"enumstructs": "methodmap"})
    label = _by(F.col("category"), labels, None)
    page = lambda sub: F.concat(F.lit(base_url + "/"), F.col("strand"), F.lit("/"), sub)
    own = element(label, F.col("name"))
    shown = F.filter("members", lambda m: m["kind"].isin("method", "property", "field"))
    inner = F.transform(shown, lambda m: F.concat(own, F.lit("/"), element(F.when(m["kind"] == "method", F.lit("function")).otherwise(m["kind"]), m["name"])))
    subs = F.when(F.col("category").isin("methodmaps", "enumstructs"), F.concat(F.array(own), F.coalesce(inner, F.array().cast("array<string>")))).otherwise(F.array(own))
    pages = symbols.where(F.col("category").isin([c for c in CATEGORIES if c != "defines"])).select("strand", F.explode(subs).alias("sub"))
    roots = symbols.select("strand") if strands is None else symbols.select("strand").unionByName(strands.select("strand"))
    every = roots.where("strand is not null").distinct().select(page(F.lit("")).alias("loc")).unionByName(pages.select(page(F.col("sub")).alias("loc")).where("loc is not null"))
    return every.withColumn("changefreq", F.lit("monthly"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``. A partial aggregation, so no key's rows gather before it."""
    rest = [c for c in rows.columns if c not in keys]
    held = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return held.select(*keys, "__r.*").select(*rows.columns)


def attach_comments(decls: DataFrame, comments: DataFrame) -> DataFrame:
    """``decls`` (file, line, ...) with doc_start and doc_end of the comment that documents each.

    That is one that ends on the line before, else one that starts on the line, of ties the one that
    starts first; ``comments`` has file, start_line, end_line, start and end. Without one both are 0.
    """
    first = lambda line: comments.groupBy("file", F.col(line).alias("at")).agg(F.min(F.struct("start", "end")).alias("c"))
    lead, tail = first("end_line").select("file", (F.col("at") + 1).alias("line"), F.col("c").alias("lead")), first("start_line").select("file", F.col("at").alias("line"), F.col("c").alias("tail"))
    joined = decls.join(lead, ["file", "line"], "left").join(tail, ["file", "line"], "left").withColumn("__c", F.coalesce("lead", "tail"))
    return joined.select(*decls.columns, F.coalesce("__c.start", F.lit(0)).cast("bigint").alias("doc_start"), F.coalesce("__c.end", F.lit(0)).cast("bigint").alias("doc_end"))


def number_commits(commits: DataFrame, repo: str = "bundle") -> DataFrame:
    """All commits of each repository numbered from 0 in order of time (then revision number and hash), before any filter."""
    return commits.withColumn("ordinal", F.row_number().over(Window.partitionBy(repo).orderBy("rev_time", "rev_count", "commit_hash")) - 1)
