"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boskage.llm import forms, leaks, lookalikes, packing, proportions
from boskage.session import stable, table


def _allocation(spark: SparkSession, sf_dir: str):
    sampled = proportions.units(table(spark, sf_dir, "group_sample"), "record_id", "dataset", "class", "feed_id", "loaded_at", "row_id")
    return sampled, proportions.allocate(sampled, table(spark, sf_dir, "sample_targets"))


def _drawn(spark: SparkSession, sf_dir: str):
    sampled, _ = _allocation(spark, sf_dir)
    sampled = stable(sampled)  # read by the counts of cells, the histogram and the draw
    allocation = stable(proportions.allocate(sampled, table(spark, sf_dir, "sample_targets")))
    return proportions.draw(sampled, allocation), allocation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, allocation = _allocation(spark, sf_dir)
    return proportions.report(allocation).where("quota > allocated").select("plan_id", "class")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn, _ = _drawn(spark, sf_dir)
    return drawn.select("plan_id", F.col("c").alias("class"), F.col("u").alias("record_id"), F.col("r").alias("row_id"))


def p1_class_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions.class_margins(_drawn(spark, sf_dir)[0])


def p1_feed_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions.second_margins(*_drawn(spark, sf_dir))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", packing.byte_tokens("text").alias("size"))
    return packing.pack(docs, table(spark, sf_dir, "containers"), "doc_id", "size")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).where("n_parts > 1 and part = 1").select("container_id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.bin_check(_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), places=True)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_pairs(table(spark, sf_dir, "documents"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_classes(table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.canonical_texts(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_sample": p1_sample, "p1_class_margins": p1_class_margins, "p1_feed_margins": p1_feed_margins, "p6_found": p6_found, "p6_fill": p6_fill, "p6_check": p6_check,
        "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found, "p8_classes": p8_classes, "p8_forms": p8_forms,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_class_margins": P1_CLASS_SQL, "p1_feed_margins": P1_FEED_SQL, "p6_found": P6_SQL, "p6_check": P6_CHECK_SQL, "p7_found": P7_SQL, "p8_found": P8_SQL, "p8_classes": P8_CLASSES_SQL}


_P1_PARTS = r"""
with r as (
  select lower(regexp_replace(dataset, '^\s+|\s+$', '', 'g')) g, translate(lower(regexp_replace(class, '^\s+|\s+$', '', 'g')), ' _', '--') c, record_id, feed_id, loaded_at, row_id
  from group_sample),
n as (select g, c, count(distinct record_id) n from r where g is not null and c is not null group by 1, 2),
t as (
  select plan_id, class, lower(regexp_replace(dataset, '^\s+|\s+$', '', 'g')) g, translate(lower(regexp_replace(class, '^\s+|\s+$', '', 'g')), ' _', '--') c,
    greatest(coalesce(min_keep, 0), coalesce((cast(target_permille as bigint) * sample_size + 999) // 1000, 0)) q
  from sample_targets)"""
P1_SQL = _P1_PARTS + """
select t.plan_id, t.class from t left join n on t.g = n.g and t.c = n.c where q > coalesce(n, 0)
"""
P1_CLASS_SQL = _P1_PARTS + """
select t.plan_id, t.c as class, cast(least(max(q), max(n)) as bigint) as drawn from t join n on t.g = n.g and t.c = n.c group by 1, 2 having least(max(q), max(n)) > 0
"""
P1_FEED_SQL = _P1_PARTS + """,
u as (select g, c, record_id, arg_max(struct_pack(s := feed_id), struct_pack(a := loaded_at, b := row_id)).s s from r where g is not null and c is not null and record_id is not null group by 1, 2, 3)
select distinct t.plan_id, cast(u.s as varchar) as second, true as held from t join u on t.g = u.g and t.c = u.c
"""
P6_SQL = """
select c.container_id, d.doc_id from documents d, containers c where d.text is not null and strlen(d.text) + 1 > c.capacity
"""
P6_CHECK_SQL = """
select c.container_id, count(*) as items, cast(sum(strlen(d.text) + 1) as bigint) as tokens, 0::bigint as overfull, 0::bigint as torn
from documents d, containers c where d.text is not null group by 1
"""


def _translate(text: str, pairs: dict[str, str], gone: str = "") -> str:
    pairs = {a: b for a, b in pairs.items() if len(a) == len(b) == 1}
    old, new = ("".join(x).replace("'", "''") for x in (pairs, pairs.values()))
    return f"translate({text}, '{old}{gone}', '{new}')"


def _form_sql(text: str) -> str:
    """The table form by two translations: of single letters, and of letters composed with an accent."""
    nfd, nfc = (lambda x, k=k: unicodedata.normalize(k, x) for k in ("NFD", "NFC"))
    composed = {c: nfc(forms.LOOK_ALIKES[nfd(c)[0]] + nfd(c)[1:]) for c in map(chr, range(0x370, 0x2000)) if len(nfd(c)) > 1 and nfd(c)[0] in forms.LOOK_ALIKES}
    first = {**forms.WIDE, **dict.fromkeys(forms.BLANKS, " "), **forms.LOOK_ALIKES}
    return f"nfc_normalize({_translate(f'nfc_normalize({_translate(text, first, forms.INVISIBLE)})', composed)})"


_P8_FORMS = f"with f as (select doc_id, text, md5({_form_sql('text')}) as form from documents where text is not null)"
P8_SQL = _P8_FORMS + """
select a.doc_id as doc_id_a, b.doc_id as doc_id_b from f a join f b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text
"""
P8_CLASSES_SQL = _P8_FORMS + """
select doc_id, min(doc_id) over (partition by form) as class_id, n_texts
from f join (select form, count(distinct text) as n_texts from f group by 1) using (form)
"""
_FOLDED = "".join(map(chr, leaks._FOLD)), "".join(leaks._FOLD.values())
_NUMBER_LINE = r"(?:[^\S\n]*[0-9lioszb|]{1,9}[^\S\n]*\n)?"
P7_SQL = rf"""
with d as (select doc_id, replace(replace(lower({_form_sql('text')}), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t from documents where text is not null),
c as (select doc_id, regexp_replace(t, '(?m)^{_NUMBER_LINE}[^\n]*?-->[^\n]*$', chr(1), 'g') as t from d),
a as (select doc_id, regexp_replace(t[strpos(t, chr(1)):], '\n{_NUMBER_LINE}[^\S\n]*[0-9lo]{{2}}:[0-9lo:,. -]*\z', '') as t from c where strpos(t, chr(1)) > 0),
b as (select doc_id, regexp_replace(regexp_replace(t, '<[^<>\n\x01]*>|\{{[^{{}}\n\x01]*\}}', '', 'g'), '\[[^\[\]\x01]*\]|\([^()\x01]*\)', ' ', 'g') as t from a),
w as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(t, '{_FOLDED[0]}', '{_FOLDED[1]}'), '[\p{{L}}\p{{N}}]+') as l from b
  union all
  select 'i', item_id, regexp_extract_all(translate(lower({_form_sql('passage')}), '{_FOLDED[0]}', '{_FOLDED[1]}'), '[\p{{L}}\p{{N}}]+') from eval_items where passage is not null),
n as (select kind, id, l, unnest(range(1, len(l) - 10)) as k from w where len(l) >= 12),
g as (select distinct kind, id, array_to_string(l[k:k + 11], ' ') as gram from n)
select distinct x.id as doc_id, y.id as item_id from g x join g y on x.gram = y.gram and x.kind = 'd' and y.kind = 'i'
"""
