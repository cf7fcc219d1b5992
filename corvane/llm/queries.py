"""The registered queries of this subpackage: thin digests of its operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bit_codes, bpe, collocations, hard_negatives, langid, license_scan, media, mil, minhash, packing, quality_rules, substring, toxicity

LABELLED, LANG_ROWS = 6000, 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_mod(by: int):
    return F.coalesce(toxicity.split_of(F.col("doc_id"), by), F.lit(-1))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repeat counts, the base verdict and the verdict with the hosts' taken into account."""
    got = quality_rules.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the bytes decoded from them."""
    import public_tokenizers

    got = bpe.byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id"])
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return got.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates of every document."""
    got = license_scan.license_scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a transport stream, digests of what is read back."""
    got = media.media_columns(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("row.doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    got = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, carry=["doc_id"])
    return got.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), limit=85, shingle=3).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the words of repeated windows."""
    got = substring.substring_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from labels outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = toxicity.labelled(docs, labels, "quality", F.coalesce(toxicity.split_of(F.col("_id"), 3), F.lit(-1)) != 1, LABELLED)
    got = mil.quality(docs, mil.learn(train), carry=["doc_id"]).select("row.doc_id", "score", "predicted")
    return got.select("doc_id", (split_mod(3) == 1).alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    got = toxicity.toxicity(docs, toxic_lexicon(docs, table(spark, sf_dir, "labels")), carry=["doc_id"]).select("row.doc_id", "score", "predicted", "n_hits")
    return got.select("doc_id", (split_mod(5) == 0).alias("held_out"), "score", "predicted", "n_hits")


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    return toxicity.learn(toxicity.labelled(docs, labels, "toxic", F.coalesce(toxicity.split_of(F.col("_id"), 5), F.lit(-1)) != 0, LABELLED))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    train = langid.train_rows(docs, F.coalesce(toxicity.split_of(F.col("_id"), 4), F.lit(-1)) != 2, LANG_ROWS)
    got = langid.language_id(docs, langid.learn(train), carry=["doc_id"]).select("row.doc_id", "lang_pred", "score", "rejected")
    return got.select("doc_id", (split_mod(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives in the score window of each positive, for every hundredth vector; some labels are shifted first."""
    e = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(e.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    got = bit_codes.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_license_scan, op4_media_columns, op5_best_fit_packing, op6_minhash_near_dedup, op7_substring_dedup, op8_quality_classifier, op9_toxicity, op10_language_id, op11_hard_negatives, op12_nearest_neighbours, op13_collocations)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LICENSE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: What op3 must find, written out for SQL: phrases with their words, and each licence wording as a regular expression
#: over words that follow one space each.
PHRASE_WORDS = [("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])]
WORDINGS = {
    "apache-2.0": r" licensed under the apache license(?: version)? 2 0",
    "cc-by-family": r"(?: this work is)? licensed under(?: the)?(?: creative commons)? cc by(?: [^ ]+){0,3}(?: international)? 4 0",
    "gpl-notice": r" licensed under the(?: gnu)?(?: lesser)? general public license(?: version(?: [^ ]+){1,1})?",
    "mit": r"(?: released)?(?: licensed)? under the mit license",
    "mit-grant": r" permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd-grant": r" redistribution and use in source and binary forms with or without modification are permitted provided that",
    "reserved-notice": r"(?: copyright(?: [^ ]+){1,8})? all rights reserved",
    "apache-2.0-header": r" licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
    r" license you may obtain a copy of the license at(?: [^ ]+){1,1} www apache org licenses license 2 0 unless required by"
    r" applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
    r" without warranties or conditions of any kind either express or implied see the license for the specific language"
    r" governing permissions and limitations under the license",
    "bsd-2-clause": r" redistribution and use in source and binary forms with or without modification are permitted provided that the"
    r" following conditions are met(?: 1)? redistributions of source code must retain the above copyright notice this list"
    r" of conditions and the following disclaimer(?: 2)? redistributions in binary form must reproduce the above copyright"
    r" notice this list of conditions and the following disclaimer in the documentation and or other materials provided with"
    r" the distribution this software is provided by(?: [^ ]+){1,12} as is and any express or implied warranties including"
    r" but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    r" in no event shall(?: [^ ]+){1,12} be liable for any direct indirect incidental special exemplary or consequential damages including but not"
    r" limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any"
    r" theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of"
    r" this software even if advised of the possibility of such damage",
    "bsd-3-clause": r" redistribution and use in source and binary forms with or without modification are permitted provided that the"
    r" following conditions are met(?: 1)? redistributions of source code must retain the above copyright notice this list"
    r" of conditions and the following disclaimer(?: 2)? redistributions in binary form must reproduce the above copyright"
    r" notice this list of conditions and the following disclaimer in the documentation and or other materials provided with"
    r" the distribution(?: 3)? neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse"
    r" or promote products derived from this software without specific prior written permission this software is provided by(?: [^ ]+){1,12} as is"
    r" and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular"
    r" purpose are disclaimed"
    r" in no event shall(?: [^ ]+){1,12} be liable for any direct indirect incidental special exemplary or consequential damages including but not"
    r" limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any"
    r" theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of"
    r" this software even if advised of the possibility of such damage",
    "isc-text": r" permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby"
    r" granted provided that the above copyright notice and this permission notice appear in all copies the software is"
    r" provided as is and(?: [^ ]+){1,6} disclaims all warranties with regard to this software"
    r" including all implied warranties of merchantability and fitness in no event shall(?: [^ ]+){1,6} be liable for any special direct indirect"
    r" or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence"
    r" or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-text": r" permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    r" documentation files the software to deal in the software without restriction including without limitation the rights"
    r" to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to"
    r" whom the software is furnished to do so subject to the following conditions the above copyright notice and this"
    r" permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the"
    r" software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
    r" merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any"
    r" claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the"
    r" software or the use or other dealings in the software",
}


def license_sql() -> str:
    hits = " union all ".join(f"select doc_id, i - 1 as place, '{label}' as label from w, unnest(range(1, len(ws) - {len(p) - 2})) t(i) where ws[i:i + {len(p) - 1}] = {p}" for label, p in PHRASE_WORDS)
    extra = ", ".join(f"case when regexp_matches(line, '{wording} ') then '{label}' end" for label, wording in WORDINGS.items())
    return f"""
    with w as (select doc_id, {LICENSE_WORDS} as ws from documents),
    hits as ({hits}),
    h as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as ls from hits group by doc_id),
    x as (select doc_id, len(ws) as n_words, list_filter([{extra}], lambda v: v is not null) as es from (select doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' as line from w))
    select x.doc_id, n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
      array_to_string(list_sort(coalesce(ls, [])), ',') as base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), es))), ',') as labels,
      case when len(es) > 0 then 1.0 when n_base > 0 then 0.5 else 0.0 end::double as score
    from x left join h using (doc_id)"""


ORACLES = {
    "op1_quality_rules": rf"""
    with d as (select doc_id, source, coalesce(text, '') as text, {WORDS} as ws from documents),
    r as (select *, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
    pos as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from r, unnest(range(1, n_words - 1)) t(i)),
    rep as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from pos where n > 1) group by doc_id),
    m as (select doc_id, source, n_words, word_chars, n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from r left join rep using (doc_id)),
    f as (select *, n_words < 50 as a, 100 * n_repeat_words > 50 * n_words as b, 100 * n_symbols > 20 * word_chars as c, 100 * n_dup_lines > 50 * n_lines as e from m),
    h as (select source, count(*) as n, count_if(a) as fa, count_if(b) as fb, count_if(c) as fc, count_if(e) as fe from f where source is not null group by source),
    l as (select source, n, unnest([fa, fb, fc, fe]) as k, unnest([1, 2, 3, 4]) as rule from h),
    p as (select rule, avg(k / n) as m, var_pop(k / n) as v from l group by rule),
    s as (select rule, m, case when v > 0 then least(greatest(m * (1 - m) / v - 1, 1.0), 1e4) else 1e4 end as g from p),
    bad as (select distinct source from l join s using (rule) where (k + m * g) / (n + g) >= 0.5)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a or b as base_failed, not (a or b) and bad.source is null as kept
    from f left join bad using (source)""",
    "op3_license_scan": license_sql(),
    "op6_minhash_near_dedup": r"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
    s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as ss from w),
    g as (select ss, min(doc_id) as least from (select doc_id, list_sort(ss) as ss from s) where len(ss) > 0 group by ss),
    x as (select least as doc_id, len(ss) as n, unnest(ss) as h from g),
    pairs as (select a.doc_id as a, b.doc_id as b from x a join x b on a.h = b.h and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    e as (select a, b from pairs union select b, a from pairs),
    reach(node, root) as (select least, least from g union select e.b, reach.root from reach join e on e.a = reach.node),
    c as (select node, min(root) as component_id from reach group by node)
    select s.doc_id, len(s.ss) as n_shingles, coalesce(component_id, s.doc_id) as component_id, s.doc_id = coalesce(component_id, s.doc_id) as kept
    from s left join g on list_sort(s.ss) = g.ss left join c on c.node = g.least""",
    "op7_substring_dedup": rf"""
    with w as (select doc_id, {WORDS} as ws from documents),
    x as (select doc_id, s, array_to_string(ws[s:s + 34], ' ') as win from w, unnest(range(1, len(ws) - 33)) t(s)),
    twice as (select doc_id, s from x join (select win from x group by win having count(*) > 1) using (win)),
    gone as (select doc_id, list(distinct p) as ps from (select doc_id, unnest(range(s, s + 35)) as p from twice) group by doc_id)
    select doc_id, len(ws) as n_words, coalesce(len(ps), 0) as n_removed,
      sha256(array_to_string(case when ps is null then ws else list_filter(ws, lambda v, i: not list_contains(ps, i)) end, ' ')) as kept_sha256
    from w left join gone using (doc_id)""",
    "op11_hard_negatives": """
    with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as z from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as anchor_id, a.label = e.label as same, e.vec_id, list_inner_product(a.z, e.z)::bigint as score from e a join e on a.vec_id % 100 = 0 and a.vec_id <> e.vec_id),
    p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
    from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score qualify rank <= 10""",
    "op13_collocations": r"""
    with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from t)),
    g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f from w, unnest(range(1, 5)) a(k), unnest(range(1, len(ws) - k + 2)) b(i) group by all),
    c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from g where k > 1 and f >= 30),
    cuts as (select c.lang, c.phrase, c.a, c.k, j, l.f as l, r.f as r, (2000000::hugeint * a // (l.f + r.f))::bigint as score from c, unnest(range(1, c.k)) t(j)
        join g l on l.lang = c.lang and l.phrase = array_to_string(ws[1:j], ' ') join g r on r.lang = c.lang and r.phrase = array_to_string(ws[j + 1:], ' ')),
    weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    kept as (select * from weakest x where not exists (select 1 from c y where y.lang = x.lang and y.k > x.k and 100 * y.a >= 80 * x.a and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
    from kept join (select lang, sum(f)::bigint as n from g where k = 1 group by lang) using (lang) qualify rank <= 2000""",
}
