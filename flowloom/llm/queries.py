"""One thin query per operator: its whole table, with production parameters, as the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontaminate import contamination
from .html_text import html_text
from .importance import importance_sample
from .language_id import language_id
from .language_model import lm_scores
from .line_dedup import HALVING, LEAST_LONG, LEAST_PAGES, LONG, RATIO, SHORT, line_dedup
from .mix_sources import MOST_COPIES, SEED, WEIGHTS, mix_sources
from .near_duplicates import near_duplicates
from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, STOP_WORDS, THRESHOLDS, quality_rules

from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _rules_sql() -> str:
    ratios = {
        "mean_word_chars": "word_chars / n1",
        "symbol_ratio": "n_symbols / n1",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)::double",
        "stop_word_ratio": "n_stop_words / n1",
    }
    kept = ["not base_failed"]
    for rule, (low, high, least) in THRESHOLDS.items():
        within = [f"{ratios[rule]} >= {low}"] * (low is not None) + [f"{ratios[rule]} <= {high}"] * (high is not None)
        kept.append(f"(n_words < {least} or ({' and '.join(within)}))")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t,
        list_filter(regexp_split_to_array(t, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D\\x20]')) ls from d),
g as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from w)),
r as (select doc_id, count(distinct p) n from (
        select doc_id, unnest(range(i, i + 5)) p from (select doc_id, i, count(*) over (partition by doc_id, k) c from g) where c > 1)
      group by doc_id),
m as (select w.doc_id, len(ws)::bigint n_words,
        length(regexp_replace(t, '[\\x09-\\x0D\\x20]', '', 'g'))::bigint word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, len(ls)::bigint n_lines,
        coalesce(r.n, 0)::bigint n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) in ({stop})))::bigint n_stop_words,
        greatest(len(ws), 1)::double n1
      from w left join r on r.doc_id = w.doc_id),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {' and '.join(kept)} kept from b
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


_BARE = "trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
_LINE_DEDUP_SQL = f"""
with d as (select doc_id, source, text, string_split(text, chr(10)) ls, coalesce('h' || source, 'n') || chr(10) tag, row_number() over () r from documents),
l as (select distinct r, source, k, md5(tag || k) key from (select r, source, tag, {_BARE} k from (select r, source, tag, unnest(ls) x from d)) where k <> ''),
g as (select *, ('0x' || substr(key, 1, 15))::bigint g from l),
m as (select r, list_sort(list(g)) al from g group by r),
s as (select source, key, length(k) chars, case when g = al[1] then al[2] else al[1] end least_, case when g = al[len(al)] then case when len(al) > 1 then al[len(al) - 1] end else al[len(al)] end most_
      from g join m on g.r = m.r),
c as (select source, key, max(chars) chars, count(*) pages, count(distinct least_) n, min(most_) < max(most_) differ from s group by 1, 2),
t as (select source, count(*) total from documents group by 1),
b as (select c.source, key from c join t on c.source is not distinct from t.source
      where n >= case when chars >= {LONG} then {LEAST_LONG} else {LEAST_PAGES} end and differ and 3 * n >= pages
        and n > {RATIO}::double * pow(2.0::double, -greatest(chars - {SHORT}, 0) / {HALVING}.0::double) * total),
bs as (select source, list(key) ks from b group by 1),
e as (select d.*, coalesce(ks, []) ks from d left join bs on d.source is not distinct from bs.source),
k as (select doc_id, ls, text, list_filter(ls, lambda x: not list_contains(ks, md5(tag || {_BARE}))) kept from e)
select doc_id, coalesce(len(ls), 0)::bigint n_lines, coalesce(len(ls) - len(kept), 0)::bigint n_dropped,
       case when text is null then null else array_to_string(kept, chr(10)) end "text"
from k
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECONTAMINATE_SQL = f"""
with d as (select doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select item_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
bw as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') s
       from (select item_id, ws, least(10, len(ws)) k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) i from b where len(ws) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') s
       from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) i from d, ks)),
o as (select doc_id, i, dw.k, item_id from dw join bw on dw.k = bw.k and dw.s = bw.s),
h as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from o) group by doc_id),
it as (select doc_id, count(*) n, string_agg(item, ',' order by item) items
       from (select distinct doc_id, item_id::varchar item from o) group by doc_id)
select d.doc_id, len(ws)::bigint n_words, coalesce(h.n, 0)::bigint n_hit, coalesce(it.n, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated
from d left join h on h.doc_id = d.doc_id left join it on it.doc_id = d.doc_id
"""


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), by_length=True).select("doc_id", "size", "source_size", "target", "taken")


_MIX_SQL = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size,
        (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / {2**52}::double u from documents),
s as (select source, sum(size)::bigint z, {list(map(float, WEIGHTS))}[1 + (row_number() over (order by source is null, source) - 1) % {len(WEIGHTS)}]::double w
      from d group by source),
f as (select *, z::double * {MOST_COPIES} cap from s),
lv as (select *, (sum(z) over ()::double - coalesce(sum(cap) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) lvl from f
       window o as (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding)),
wl as (select *, max(case when not cap / w < lvl then lvl end) over () water from lv),
t as (select source, z, case when cap / w < lvl then cap else least(cap, water * w) end target from wl),
p as (select *, case when z > 0 then floor(target / z) else 0 end whole from t),
q as (select *, target - whole * z due from p),
x as (select *, length(bin(size))::double x from d),
lx as (select source, x, sum(size)::bigint words from x group by 1, 2),
fx as (select lx.source, x, case when sum(x * words) over b > 0 then (due - coalesce(sum(words) over a, 0)) / sum(x * words) over b else 0 end fac
       from lx join q on lx.source is not distinct from q.source
       window a as (partition by lx.source order by x desc rows between unbounded preceding and 1 preceding), b as (partition by lx.source order by x desc rows between current row and unbounded following)),
sc as (select source, max_by(fac, x) scale from fx where fac * x < 1 group by 1),
r as (select x.*, q.z, target, whole, due, least(coalesce(sc.scale, 0) * x.x, 1) sc from x join q on x.source is not distinct from q.source left join sc on x.source is not distinct from sc.source),
k as (select *, case when sc >= 1 then 0.0 when sc <= 0 then 'inf'::double else (u / (1 - u)) / (sc / (1 - sc)) end rk from r),
c as (select *, coalesce(sum(size) over (partition by source order by rk, doc_id, size rows between unbounded preceding and 1 preceding), 0) so_far from k)
select doc_id, size, z source_size, target,
       ((whole + case when rk < 'inf'::double and so_far + size / 2.0::double <= due then 1 else 0 end) * size)::bigint taken
from c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_html_text": op2_html_text,
        "op3_toxicity": op3_toxicity,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_importance_sample": op5_importance_sample,
        "op6_language_id": op6_language_id,
        "op7_decontaminate": op7_decontaminate,
        "op8_mix_sources": op8_mix_sources,
        "op9_language_model": op9_language_model,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": _LINE_DEDUP_SQL,
        "op7_decontaminate": _DECONTAMINATE_SQL,
        "op8_mix_sources": _MIX_SQL,
        "op10_quality_rules": _rules_sql(),
    }
