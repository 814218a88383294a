"""SQL twins of the newer training-data queries."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

FILL_IN_MIDDLE = r"""
    with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
    l as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as lines,
            list_transform([1, 9, 17, 25], lambda a: cast('0x' || substr(h, a, 8) as bigint)) as r from d),
    k as (select *, len(lines) as n, least(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) as a, greatest(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) as b from l),
    p as (select doc_id, text, cast(n as bigint) as n, array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:b], '') as middle,
            array_to_string(lines[b + 1:n], '') as suffix,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 100 then 'plain'
                when r[4] % 100 < 50 then 'spm' else 'psm' end as form from k)
    select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
        sha256(text) as restored_sha256
    from p"""

CONTAMINATION = rf"""
    with b as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    win as (select distinct item, least(len(w), 10) as size, array_to_string(w[i:i + 9], ' ') as win
        from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
    d as (select row_number() over () as row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    pos as (select row, size, i, array_to_string(w[i:i + size - 1], ' ') as win
        from (select row, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from win) where len(w) >= size)),
    hit as (select row, i, pos.size, item from pos join win using (win)),
    words as (select row, count(distinct place) as n_hit from (select row, unnest(range(i, i + size)) as place from (select distinct row, i, size from hit)) group by row),
    items as (select row, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct row, item from hit) group by row)
    select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
        coalesce(n_hit, 0) > 0 as contaminated
    from d left join words using (row) left join items using (row)"""

#: crc32 of ASCII text, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::ubigint], list_transform(string_split({0}, ''), lambda c: ascii(c)::ubigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda c, z: xor(c >> 1, 3988292384::ubigint * (c & 1)))), 4294967295::ubigint)"""


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen(cast({f} as varchar)) || ':' || cast({f} as varchar), '-')" for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _tree(name: str, levels: int, fanout: int) -> str:
    """Levels ``name0`` (g, i, n, d) upwards; each lists the nodes of groups that are not done."""
    out = []
    for k in range(1, levels + 1):
        out.append(f"""{name}{k} as (select g, i // {fanout} as i, any_value((n + {fanout - 1}) // {fanout}) as n, sha256(string_agg(d, '' order by i)) as d
            from {name}{k - 1} where n > 1 group by g, i // {fanout})""")
    tops = " union all ".join(f"select g, d from {name}{k} where n = 1" for k in range(levels + 1))
    return ",\n".join([*out, f"{name}_top as ({tops})"])


def _climb(name: str, step: str, levels: int, fanout: int, keep: str) -> str:
    """From ``step``0 (g, i, proof, fold) up all levels: siblings are appended and folded."""
    out = []
    for k in range(levels):
        out.append(f"""{step}s{k} as (select a.g, a.i, coalesce(string_agg(b.d, '' order by b.i) filter (b.i < a.i), '') as lo,
                coalesce(string_agg(b.d, '' order by b.i) filter (b.i > a.i), '') as hi
            from {name}{k} a join {name}{k} b on a.g = b.g and a.i // {fanout} = b.i // {fanout} and a.n > 1 group by a.g, a.i),
        {step}{k + 1} as (select {keep}, x.g, case when s.i is null then x.i else x.i // {fanout} end as i, proof || coalesce(lo || hi, '') as proof,
                case when s.i is null then fold else sha256(lo || fold || hi) end as fold
            from {step}{k} x left join {step}s{k} s on x.g = s.g and x.i = s.i)""")
    return ",\n".join(out)


def manifest(levels: int = 9, upper: int = 4, fanout: int = 3) -> str:
    """Groups of up to fanout ** levels leaves and fanout ** upper groups: enough for the tables the twin is run on."""
    odd = f"({_CRC.format('cast(doc_id as varchar)')}) % 2 = 0"
    return f"""
    with leaf as (select doc_id, case when source is null then '' else '=' || source end as g, {_leaf('text')} as leaf,
            case when {odd} then {_leaf("replace(text, chr(10), '')")} else {_leaf('text')} end as changed from documents),
    placed as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from leaf),
    a0 as (select g, i, n, leaf as d from placed),
    {_tree('a', levels, fanout)},
    b0 as (select '' as g, row_number() over (order by encode(g)) - 1 as i, count(*) over () as n, d, g as own from a_top),
    {_tree('b', upper, fanout)},
    x0 as (select doc_id, leaf, g as own, g, i, '' as proof, changed as fold from placed),
    {_climb('a', 'x', levels, fanout, 'doc_id, leaf, own')},
    y0 as (select doc_id, leaf, x.own, '' as g, b0.i, proof, fold from x{levels} x join b0 on x.own = b0.own),
    {_climb('b', 'y', upper, fanout, 'doc_id, leaf, own')}
    select doc_id, leaf, a_top.d as subroot, b_top.d as root, sha256(proof) as proof_sha256, fold as folded_root, fold = b_top.d as verified
    from y{upper} y join a_top on y.own = a_top.g cross join b_top"""
