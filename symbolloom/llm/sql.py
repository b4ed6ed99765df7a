"""DuckDB SQL of the text queries that SQL can express over whole tables.

Tokenisation, syntax and documentation have none: they are tested against other implementations and small
fixtures in tests/llm.
"""

from __future__ import annotations

_WORDS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda w: lower(w))"


def oracle_sql() -> dict[str, str]:
    share = f"""
        with docs as (select doc_id, {_WORDS} as w from documents),
        runs as (select doc_id, i, hash(w[i:i+7]) as h from (select doc_id, w, unnest(range(1, len(w)::bigint - 6)) as i from docs)),
        again as (select doc_id, i from (select doc_id, i, row_number() over (partition by doc_id, h order by i) as n from runs) where n > 1),
        hit as (select doc_id, count(distinct j)::bigint as n from (select doc_id, unnest(range(i, i + 8)) as j from again) group by doc_id),
        shares as (select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_repeated from docs d left join hit h using (doc_id))"""
    blank, mark = r"[ \t\n\f\r]", "chr(57344)"
    words = lambda table, key: rf"""
        select {key}, list_transform(w, lambda x: lower(ltrim(x, {mark}))) as v, list_transform(w, lambda x: ltrim(x, {mark})) as b, list_transform(w, lambda x: starts_with(x, {mark})) as m
        from (select {key}, regexp_extract_all(regexp_replace(coalesce(text, ''), '(^{blank}*|[.!?]{blank}+)(\p{{Lu}})', '\1' || {mark} || '\2', 'g'), {mark} || '?[\p{{L}}\p{{N}}]+') as w from {table})"""  # noqa: E731
    typed = lambda name, key: rf"""
        {name}_t as (select *, list_transform(b, lambda x, i: case when regexp_full_match(x, '\p{{N}}+') then '#' when regexp_full_match(x, '\p{{N}}+\p{{L}}+') then '%' when regexp_matches(x, '\p{{Lu}}') then '@'
                     when i > 1 and regexp_full_match(b[i - 1], '\p{{N}}+') and regexp_full_match(x, '\p{{L}}+') then '~' else '' end) as t from {name}_w),
        {name}_f as (select {key}, v, t from {name}_t union all select {key}, v, list_transform(t, lambda x, i: case when x = '@' and m[i] and regexp_full_match(b[i], '\p{{Lu}}[^\p{{Lu}}]*') then '' else x end) from {name}_t),
        {name}_s as (select {key}, v[i:i+11] as v, t[i:i+11] as t from (select *, unnest(range(1, len(v)::bigint - 10)) as i from {name}_f)),
        {name}_k as (select *, list_transform(v, lambda x, i: t[i] || ':' || x) as k from {name}_s),
        {name} as (
            select distinct {key}, hash(v) as h, 1 as verbatim from {name}_k
            union all select distinct {key}, hash(list_transform(v, lambda x, i: case when t[i] = '' then x else t[i] || list_position(k, k[i]) end)), 0 from {name}_k where len(list_filter(t, lambda x: x = '')) between 6 and 11)"""  # noqa: E731
    return {
        "p9_templates": f"""
            with d_w as ({words("documents", "doc_id")}), e_w as ({words("eval_items", "item_id")}), {typed("e", "item_id")}, {typed("d", "doc_id")}
            select doc_id, item_id, max(d.verbatim) as verbatim from d join e on d.h = e.h and d.verbatim = e.verbatim group by doc_id, item_id""",
        "p9_found": f"""
            with d as (select doc_id, {_WORDS} as w from documents), e as (select item_id, {_WORDS} as w from eval_items),
            dr as (select doc_id, hash(w[i:i+11]) as h from (select doc_id, w, unnest(range(1, len(w)::bigint - 10)) as i from d)),
            er as (select item_id, hash(w[i:i+11]) as h from (select item_id, w, unnest(range(1, len(w)::bigint - 10)) as i from e))
            select distinct doc_id, item_id from dr join er using (h)""",
        "p10_share": share + " select doc_id, n_words, n_repeated, coalesce(round(n_repeated / nullif(n_words, 0), 6), 0)::double as share from shares",
        "p10_found": share + " select doc_id from shares where n_words > 0 and n_repeated * 10 >= n_words * 3",
    }
