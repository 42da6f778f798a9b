"""SQL with the same results as queries of this subpackage, where SQL can express them."""

from __future__ import annotations

_P2 = """with w as (select id, regexp_extract_all(lower(visual_text), '[\\p{L}\\p{N}\\p{M}_]+') as ws from exhibits where visual_text is not null),
g as (select id, i, array_to_string(ws[i:i+7], ' ') as gram from (select id, ws, unnest(generate_series(1, len(ws) - 7)) as i from w where len(ws) >= 8)),
s as (select id, i from (select id, i, min(i) over (partition by id, gram) as first from g) where i > first),
c as (select id, count(*) as covered from (select distinct id, unnest(generate_series(i, i + 7)) as at from s) group by 1),
p as (select w.id, len(ws) as n_words, coalesce(covered, 0) as covered from w left join c on c.id = w.id)
"""
_P8 = """with d as (select doc_id, regexp_extract_all(regexp_replace(lower(text), '[''’­]', '', 'g'), '[\\p{L}\\p{N}]+') as ws from documents where text is not null),
e as (select item_id, regexp_extract_all(regexp_replace(lower(text), '[''’­]', '', 'g'), '[\\p{L}\\p{N}]+') as ws from eval_items where text is not null),
dg as (select doc_id, array_to_string(ws[i:i+11], ' ') as gram from (select doc_id, ws, unnest(generate_series(1, len(ws) - 11)) as i from d where len(ws) >= 12)),
eg as (select item_id, array_to_string(ws[i:i+11], ' ') as gram from (select item_id, ws, unnest(generate_series(1, len(ws) - 11)) as i from e where len(ws) >= 12))
"""

# Equal grams at a fixed distance that follow each other without a gap are one repeat.
_P2_LONGEST = """, k as (select a.id, a.i, b.i - a.i as far from g a join g b on a.id = b.id and a.gram = b.gram and a.i < b.i),
r as (select id, count(*) + 7 as len from (select id, far, i - row_number() over (partition by id, far order by i) as run from k) group by id, far, run),
l as (select id, max(len) as longest from r group by 1)
select e.id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(covered, 0) as bigint) as repeated_words, coalesce(covered / nullif(n_words, 0), 0.0) as repeated_share,
cast(coalesce(longest, 0) as bigint) as longest_repeat from exhibits e left join p on p.id = e.id left join l on l.id = e.id"""
# Runs of equal grams are passages; the share counts the item's words that lie in any of them.
_P8_ITEMS = """, dp as (select doc_id, i, array_to_string(ws[i:i+11], ' ') as gram from (select doc_id, ws, unnest(generate_series(1, len(ws) - 11)) as i from d where len(ws) >= 12)),
ep as (select item_id, j, n, array_to_string(ws[j:j+11], ' ') as gram from (select item_id, ws, len(ws) as n, unnest(generate_series(1, len(ws) - 11)) as j from e where len(ws) >= 12)),
m as (select doc_id, item_id, i, j, n from dp join ep using (gram)),
runs as (select doc_id, item_id, count(*) + 11 as len from (select doc_id, item_id, i - j as far, j - row_number() over (partition by doc_id, item_id, i - j order by j) as run from m) group by doc_id, item_id, far, run),
words as (select doc_id, item_id, n, count(distinct w) as covered from (select doc_id, item_id, n, unnest(generate_series(j, j + 11)) as w from m) group by 1, 2, 3)
select item_id, count(*) as documents, max(covered / n) as max_item_share, max(longest) as longest_passage
from words join (select doc_id, item_id, max(len) as longest from runs group by 1, 2) using (doc_id, item_id) group by 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_profile": _P2 + _P2_LONGEST,
        "p8_leaked_items": _P8 + _P8_ITEMS,
        "p2_found": _P2 + "select id as exhibit_id from p where n_words > 0 and covered / n_words >= 0.3",
        "p8_found": _P8 + "select distinct doc_id, item_id from dg join eg using (gram)",
    }
