"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from tidewright.llm.bpe import op8_byte_bpe
from tidewright.llm.codes import op12_vector_codes
from tidewright.llm.decontaminate import op1_decontamination
from tidewright.llm.hosts import op7_url_filter
from tidewright.llm.jaccard import op3_jaccard
from tidewright.llm.langid import op10_language
from tidewright.llm.lines import op5_lines
from tidewright.llm.merkle import op13_merkle
from tidewright.llm.mixing import op11_mixing
from tidewright.llm.secrets import op4_secrets
from tidewright.llm.substrings import op2_substrings
from tidewright.llm.tokenfiles import op6_token_files
from tidewright.llm.transport import op9_media

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_substrings, op3_jaccard, op4_secrets, op5_lines, op6_token_files, op7_url_filter, op8_byte_bpe, op9_media, op10_language, op11_mixing, op12_vector_codes, op13_merkle)}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as x
            from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from windows),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
hits as (select doc_id, i, places.n, item from places join windows on windows.n = places.n and windows.x = array_to_string(w[i:i + places.n - 1], ' ')),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

OP2 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as x from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
first as (select x, min(doc_id) as least from places group by x),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from places join first using (x) where least < doc_id)),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select words.doc_id, count(*) as n, string_agg(word, ' ' order by words.p) as t from words anti join gone on words.doc_id = gone.doc_id and words.p = gone.p group by words.doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

OP3 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as x from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from d union select reach.doc_id, b from reach join both_ways on both_ways.a = reach.other)
select reach.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(other) as component_id
from reach left join n on n.doc_id = reach.doc_id group by reach.doc_id
"""

OP11 = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, sha256(coalesce('i' || doc_id, 't' || sha256(coalesce(text, '')))) as h from documents),
s as (select source, sum(size)::hugeint as s, row_number() over (order by source nulls last) - 1 as pos from d group by source),
w as (select source, s, [5, 2, 1][pos % 3 + 1]::hugeint as w from s),
-- Sources fill up in the order of what they have for their weight: 10 * s / w is a whole number.
o as (select *, row_number() over (order by s * (10 // w), source nulls last) as k, sum(s) over () as total from w),
p as (select *, coalesce(sum(s) over (order by k rows between unbounded preceding and 1 preceding), 0) as full_s, sum(w) over (order by k rows between current row and unbounded following) as open_w from o),
least_open as (select k, 3 * total - 4 * full_s as rest, open_w from p where w * (3 * total - 4 * full_s) <= 4 * s * open_w order by k limit 1),
t as (select source, s, case when p.k < coalesce((select k from least_open), 1 << 60) then (2 * s)::double else (w * (select rest from least_open))::double / (2 * (select open_w from least_open))::double end as target from p),
r as (select *, case when s > 0 then target / s::double else 0 end as rate from t),
draws as (select d.doc_id, d.source, d.size, r.s, r.target, j, (floor(rate) + case when (('0x' || substr(h, 8 * j + 1, 8))::bigint)::double / 4294967296 < rate - floor(rate) then 1 else 0 end)::bigint as copies, row_number() over () as row
          from d join r on d.source is not distinct from r.source, (select unnest(range(8)) as j)),
sums as (select source, j, sum(size * copies) as taken, any_value(target) as target from draws group by source, j),
best as (select source, arg_min(j, (abs(taken - target), j)) as j from sums group by source)
select doc_id, size, s::bigint as source_size, target, size * copies as taken, copies from draws join best on draws.source is not distinct from best.source and draws.j = best.j
"""


def _op12(rounds: int = 6) -> str:
    """Rounds are spelled out, one after the other."""
    nearest = "select vec_id, part, min(b) as b from (select c.vec_id, c.part, {{'d': sum((c.v - e.v) * (c.v - e.v)), 'e': e.entry}} as b from comps c join book{0} e using (part, place) group by c.vec_id, c.part, e.entry) group by vec_id, part"
    steps = [r"""
with kept as (select vec_id, label, embedding, row_number() over (order by vec_id) as k from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comps as materialized (select vec_id, label, k, i // 8 as part, i % 8 as place, floor(4096 * embedding[i + 1]::double)::bigint as v from kept, (select unnest(range(64)) as i)),
book0 as materialized (select part, k - 1 as entry, place, v from comps where k <= 16)"""]
    for i in range(rounds):
        steps.append(f"near{i} as materialized ({nearest.format(i)})")
        steps.append(f"mean{i} as (select c.part, b.e as entry, c.place, (sum(c.v) - ((sum(c.v) % count(*)) + count(*)) % count(*)) // count(*) as v from comps c join near{i} using (vec_id, part) group by c.part, b.e, c.place)")
        steps.append(f"book{i + 1} as materialized (select part, entry, place, coalesce(m.v, b.v)::bigint as v from book{i} b left join mean{i} m using (part, entry, place))")
    steps.append(f"final as materialized ({nearest.format(rounds)})")
    steps.append(f"digest as (select sha256(string_agg(v::varchar, ',' order by part, entry, place)) as h from book{rounds})")
    steps.append("codes as (select vec_id, string_agg(format('{:02x}', b.e), '' order by part) as code, sum(b.d)::bigint as error from final group by vec_id)")
    return ",\n".join(steps) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from codes join kept using (vec_id), digest"


def _op13(levels: int = 5) -> str:
    """Trees of up to 16 ** levels nodes; one that has come to its root stays as it is at the levels above."""
    field = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    bit = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)), xor(c, b))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: {bit}, 4294967295::bigint), 4294967295)"
    steps = [f"""
with d as materialized (select row_number() over () as id, doc_id, source, {leaf('text')} as leaf, case when {crc} % 5 = 0 then {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as other from documents),
a0 as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from d),
an0 as (select source as tree, pos, leaf as digest, n from a0)"""]

    def tree(name: str, steps: list[str]) -> None:
        for k in range(levels):
            steps.append(f"{name}r{k} as materialized (select tree, pos // 16 as up, list(digest order by pos) as members, n from {name}n{k} where n > 1 group by tree, up, n)")
            steps.append(f"{name}n{k + 1} as materialized (select tree, up as pos, sha256(array_to_string(members, '')) as digest, (n + 15) // 16 as n from {name}r{k} union all from {name}n{k} where n = 1)")

    def fold(name: str, start: str, out: str, steps: list[str]) -> str:
        for k in range(levels):
            sides = "coalesce(array_to_string(members[1:f.pos % 16], ''), '')", "coalesce(array_to_string(members[f.pos % 16 + 2:], ''), '')"
            steps.append(f"{out}{k} as materialized (select f.id, f.tree, f.pos // 16 as pos, case when up is null then cur else sha256({sides[0]} || cur || {sides[1]}) end as cur, case when up is null then proof else proof || {sides[0]} || {sides[1]} end as proof from {start} f left join {name}r{k} r on r.tree is not distinct from f.tree and r.up = f.pos // 16)")
            start = f"{out}{k}"
        return start

    tree("a", steps)
    steps.append(f"sub as materialized (select tree as source, digest, row_number() over (order by tree nulls first) - 1 as pos, count(*) over () as n from an{levels})")
    steps.append("bn0 as (select 0 as tree, pos, digest, n from sub)")
    tree("b", steps)
    steps.append("f as (select id, source as tree, pos, coalesce(other, leaf) as cur, '' as proof from a0)")
    last = fold("a", "f", "f", steps)
    steps.append(f"g as (select id, 0 as tree, sub.pos, cur, proof from {last} x join sub on sub.source is not distinct from x.tree)")
    last = fold("b", "g", "g", steps)
    return ",\n".join(steps) + f"\nselect doc_id, leaf, sub.digest as subroot, top.digest as root, sha256(proof) as proof_sha256, cur as folded_root, cur = top.digest as verified from d join {last} using (id) join sub on sub.source is not distinct from d.source, bn{levels} top"


SQL = {"op1_decontamination": OP1, "op2_substrings": OP2, "op3_jaccard": OP3, "op11_mixing": OP11, "op12_vector_codes": _op12(), "op13_merkle": _op13()}
