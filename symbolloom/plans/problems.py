"""The queries of the general data problems, by the problem's number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolloom.operators import hierarchy, history, incremental, nested, snapshot_diff
from symbolloom.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    attributes = [F.col(c) for c in ("created.count", "kind", "return_type", "parent", "signature", "brief")]
    return history.versions(table(spark, sf, "symbol_updates"), F.col("last_updated.count"), [F.col("received_at"), F.col("update_id")], F.col("is_deleted"), attributes)


def p2_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.declared(table(spark, sf, "methodmaps"))).withColumnRenamed("tree", "bundle")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_intervals(spark, sf).select("bundle", "name", "root", "depth", "path", "below", "state")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_diff.changes(table(spark, sf, "snapshots"), snapshot_diff.symbol_attributes())


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    flat = nested.flatten(table(spark, sf, "bundle_files"), levels=("item",), with_text=False)
    return flat.select("file_id", "strand", "category", "symbol", "member_kind", "member", "item_kind", "ord")


def p4_symbols(spark: SparkSession, sf: str) -> DataFrame:
    flat = nested.flatten(table(spark, sf, "bundle_files"), levels=("symbol",))
    doc = F.from_json("json", "name string, kind string, returnType string, parent string, refLine string")
    return flat.select("file_id", "strand", "category", "symbol", doc.alias("d")).select("file_id", "strand", "category", "symbol", "d.name", "d.kind", F.col("d.returnType").alias("return_type"), "d.parent", F.col("d.refLine").cast("bigint").alias("ref_line"))


def p4_members(spark: SparkSession, sf: str) -> DataFrame:
    flat = nested.flatten(table(spark, sf, "bundle_files"), levels=("member",))
    doc = F.from_json("json", "name string, kind string, type string, value string, returnType string")
    return flat.select("file_id", "strand", "category", "symbol", "member_kind", "member", doc.alias("d")).select("file_id", "strand", "category", "symbol", "member_kind", "member", "d.name", "d.kind", "d.type", "d.value", F.col("d.returnType").alias("return_type"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "runs").select("bundle", "run_id", "started_at", F.coalesce(F.lower("status") == "ok", F.lit(False)).alias("ok"))
    content = ["bundle", "strand", F.col("version.hash"), "content_sha"]
    return incremental.deltas(table(spark, sf, "deliveries"), runs, "bundle", "delivered_at", "delivery_id", content)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p2_found, p2_intervals, p3_found, p4_found, p4_symbols, p4_members, p7_found)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over whole tables, written apart from the operators. p2_intervals has none: numbering is free."""
    symbols = """
            with docs as (select file_id, json(body) as j from bundle_files where json_valid(body)),
            strands as (select file_id, k as strand, json_extract(j, '$.strands."' || k || '"') as j from (select file_id, j, unnest(json_keys(j, '$.strands')) as k from docs where json_type(j, '$.strands') = 'OBJECT')),
            cats as (select file_id, strand, c as category, json_extract(j, '$.' || c) as j from strands, unnest(['functions', 'methodmaps', 'enumstructs', 'constants', 'defines', 'enums', 'typesets', 'typedefs']) t(c) where json_type(j, '$.' || c) = 'OBJECT'),
            syms as (select file_id, strand, category, k as symbol, json_extract(j, '$."' || k || '"') as d from (select *, unnest(json_keys(j)) as k from cats))"""
    return {
        "p4_symbols": symbols + " select file_id, strand, category, symbol, d->>'name' as name, d->>'kind' as kind, d->>'returnType' as return_type, d->>'parent' as parent, try_cast(d->>'refLine' as bigint) as ref_line from syms",
        "p4_members": symbols + """,
            mems as (select file_id, strand, category, symbol, kind, k as member, json_extract(j, '$."' || k || '"') as d from (
                select file_id, strand, category, symbol, kind, json_extract(d, '$.' || kind) as j, unnest(json_keys(d, '$.' || kind)) as k
                from syms, unnest(['methods', 'properties', 'fields', 'entries', 'types']) t(kind) where json_type(d, '$.' || kind) = 'OBJECT'))
            select file_id, strand, category, symbol, kind as member_kind, member, d->>'name' as name, d->>'kind' as kind, d->>'type' as type, d->>'value' as value, d->>'returnType' as return_type from mems""",
        "p1_found": """
            with held as (
                select bundle, strand, category, name, last_updated.count as ver, coalesce(is_deleted, false) as gone,
                       struct_pack(a := created.count, b := kind, c := return_type, d := parent, e := signature, f := brief) as s
                from symbol_updates where last_updated is not null and last_updated.count is not null
                qualify row_number() over (partition by bundle, strand, category, name, last_updated.count order by received_at desc, update_id desc) = 1),
            steps as (
                select *, lag(gone) over w as was_gone, lag(s) over w as before, row_number() over w as n
                from held window w as (partition by bundle, strand, category, name order by ver)),
            events as (
                select *, not gone and (n = 1 or was_gone or s is distinct from before) as begins from steps
                where gone or n = 1 or was_gone or s is distinct from before),
            ends as (select *, lead(ver) over (partition by bundle, strand, category, name order by ver) as later from events)
            select bundle, strand, category, name, ver as valid_from, coalesce(later, -1)::bigint as valid_to from ends where begins""",
        "p2_found": """
            with recursive held as (
                select bundle, trim(name) as name, nullif(trim(parent), '') as parent from methodmaps where bundle is not null and name is not null
                qualify row_number() over (partition by bundle, trim(name) order by version.count desc nulls last, map_id desc) = 1),
            nodes as (
                select h.bundle, h.name, p.name as parent from held h left join held p on p.bundle = h.bundle and p.name = h.parent),
            tree as (
                select bundle, name, name as root, 0::bigint as depth, name as path, [name] as line from nodes where parent is null
                union all
                select n.bundle, n.name, t.root, t.depth + 1, t.path || '/' || n.name, list_append(t.line, n.name)
                from tree t join nodes n on n.bundle = t.bundle and n.parent = t.name),
            below as (
                select bundle, up as name, count(*) - 1 as below from (select bundle, unnest(line) as up from tree) group by all),
            rest as (select n.* from nodes n anti join tree t on t.bundle = n.bundle and t.name = n.name),
            walk as (
                select bundle, name, parent as up from rest
                union
                select w.bundle, w.name, r.parent from walk w join rest r on r.bundle = w.bundle and r.name = w.up)
            select t.bundle, t.name, t.root, t.depth, t.path, b.below::bigint as below, 'tree' as state
            from tree t join below b on b.bundle = t.bundle and b.name = t.name
            union all
            select bundle, name, '', -1, '', -1, case when bool_or(up = name) then 'on_cycle' else 'below_cycle' end from walk group by bundle, name""",
        "p3_found": """
            with held as (
                select bundle, strand, version.count as rev, category, name,
                       struct_pack(a := docs, b := kind, c := return_type, d := parent, e := arguments, f := list_sort(list_distinct(members))) as s
                from snapshots where bundle is not null and strand is not null and version.count is not null
                qualify row_number() over (partition by bundle, strand, version.count, category, name order by decl_ord desc nulls last) = 1),
            revs as (
                select *, lag(rev) over w as prev, lead(rev) over w as next
                from (select distinct bundle, strand, rev from held) window w as (partition by bundle, strand order by rev)),
            rows as (select h.*, r.prev, r.next from held h join revs r using (bundle, strand, rev))
            select n.bundle, n.strand, n.category, n.name, n.rev as rev_count, case when o.bundle is null then 'added' else 'changed' end as change
            from rows n left join rows o on o.bundle = n.bundle and o.strand = n.strand and o.rev = n.prev and o.category is not distinct from n.category and o.name is not distinct from n.name
            where n.prev is not null and (o.bundle is null or o.s is distinct from n.s)
            union all
            select o.bundle, o.strand, o.category, o.name, o.next, 'removed'
            from rows o left join rows n on n.bundle = o.bundle and n.strand = o.strand and n.rev = o.next and o.category is not distinct from n.category and o.name is not distinct from n.name
            where o.next is not null and n.bundle is null""",
        "p4_found": """
            with docs as (select file_id, json(body) as j from bundle_files where json_valid(body)),
            strands as (select file_id, k as strand, json_extract(j, '$.strands."' || k || '"') as j from (select file_id, json_extract(j, '$') as j, unnest(json_keys(j, '$.strands')) as k from docs where json_type(j, '$.strands') = 'OBJECT')),
            cats as (select file_id, strand, c as category, json_extract(j, '$.' || c) as j from strands, unnest(['functions', 'methodmaps', 'enumstructs', 'constants', 'defines', 'enums', 'typesets', 'typedefs']) t(c) where json_type(j, '$.' || c) = 'OBJECT'),
            syms as (select file_id, strand, category, k as symbol, json_extract(j, '$."' || k || '"') as j from (select *, unnest(json_keys(j)) as k from cats)),
            mems as (select file_id, strand, category, symbol, kind, k as member, json_extract(j, '$."' || k || '"') as j from (
                select file_id, strand, category, symbol, kind, json_extract(j, '$.' || kind) as j, unnest(json_keys(j, '$.' || kind)) as k
                from syms, unnest(['methods', 'properties', 'fields', 'entries', 'types']) t(kind) where json_type(j, '$.' || kind) = 'OBJECT')),
            every as (select file_id, strand, category, symbol, '' as kind, '' as member, j from syms union all select * from mems),
            lists as (
                select *, 'tag' as item, json_extract(j, '$.docs.tags') as l from every
                union all select *, 'argument', json_extract(j, '$.arguments') from every where kind = 'methods' or (kind = '' and category = 'functions')
                union all select *, 'argument', json_extract(j, '$.parsedSignature.arguments') from every)
            select file_id, strand, category, symbol, kind as member_kind, member, item as item_kind, unnest(range(json_array_length(l)::bigint)) as ord
            from lists where json_type(l) = 'ARRAY'""",
        "p7_found": """
            with ok as (select distinct bundle, run_id, started_at from runs where lower(status) = 'ok'),
            fresh as (
                select * from deliveries where bundle is not null and delivered_at is not null
                qualify row_number() over (partition by bundle, strand, version.hash, content_sha order by delivered_at, delivery_id) = 1)
            select run_id, delivery_id from (
                select r.run_id, d.delivery_id, row_number() over (partition by d.delivery_id order by r.started_at, r.run_id) as n
                from fresh d join ok r on r.bundle = d.bundle and r.started_at >= d.delivered_at) where n = 1""",
    }
