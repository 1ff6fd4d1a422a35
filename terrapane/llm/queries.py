"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score

    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = score(docs, docs.where(F.coalesce(fold, F.lit(0)) != 1))  # a null id has no remainder, so it is not held out
    return found.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, 80)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), 1024)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_columns import payload_images

    return payload_images(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "value_sha256", "probability")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, sample

    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = sample(docs.where(F.coalesce(fold, F.lit(0)) != 1), "lang")
    found = identify(docs, model).select("doc_id", "lang_pred", "score")
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import boundaries, write_tokens

    return boundaries(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), end_id=2))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")  # no overflow
    return manifest(table(spark, sf_dir, "documents"), changed={"n_chars": more}, where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_html_extraction": op3_html_extraction,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_media_columns": op6_media_columns,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
    "op11_token_store": op11_token_store,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
        with items as (select item_id, {_WORDS} w from benchmark), docs as (select doc_id, {_WORDS} w from documents),
        i as (select distinct item_id, least(len(w), 5) k, unnest([array_to_string(w[n : n + least(len(w), 5) - 1], ' ') for n in range(1, len(w) - least(len(w), 5) + 2)]) s from items where len(w) > 0),
        size as (select item_id, count(*) n from i group by 1),
        d as (select distinct doc_id, k, unnest([array_to_string(w[n : n + k - 1], ' ') for n in range(1, len(w) - k + 2)]) s from docs, (select distinct k from i) where len(w) >= k),
        hit as (select doc_id, i.item_id, count(*) c from d join i using (k, s) group by 1, 2)
        select doc_id, hit.item_id, cast(c as bigint) as shared, cast(n as bigint) as n_item from hit join size using (item_id) where 100 * c >= 80 * n""",
    "op4_jaccard_join": f"""
        with recursive docs as (select doc_id, {_WORDS} w from documents),
        sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else [array_to_string(w[n : n + 3], ' ') for n in range(1, len(w) - 2)] end) s from docs),
        size as (select doc_id, count(*) n from sh group by 1),
        common as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        link as (select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        both_ways as (select a, b from link union select b, a from link),
        reach as (select doc_id, doc_id as r from docs union select reach.doc_id, b from reach join both_ways on a = r)
        select reach.doc_id, cast(coalesce(any_value(n), 0) as bigint) as n_shingles, min(r) as component_id from reach left join size on size.doc_id = reach.doc_id group by 1""",
    "op12_filter_audit": r"""
        with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        f as (select w.doc_id, part, text, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) as c, regexp_matches(text, '[#$%&*|]') as d from w),
        e as (select f.*, f.doc_id > min(f.doc_id) over (partition by text) as e from f),
        l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
        s as (select part, [x[1] for x in [('A', a), ('B', b), ('C', c), ('D', d), ('E', coalesce(e, false))] if x[2]] as failed, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, count(*) as n from e left join l using (doc_id) group by all),
        x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x), o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        t as (select filter_order, cast(step as int) as step, filter_order[step] as own, string_split(filter_order[1 : step - 1], '') as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
        r as (select part, filter_order, step, own, sum(case when not list_contains(failed, own) and not list_has_any(failed, before) then n else 0 end)::bigint as kept, sum(case when list_contains(failed, own) and not list_has_any(failed, before) then n else 0 end)::bigint as removed,
          sum(case when list_contains(failed, own) and list_has_any(failed, before) then n else 0 end)::bigint as redundant, sum(case when failed = [own] then n else 0 end)::bigint as unique_fails,
          sum(case when list_contains(failed, own) and not list_has_any(failed, before) then n * good else 0 end)::bigint as good_lost, sum(case when list_contains(failed, own) and not list_has_any(failed, before) then n * toxic else 0 end)::bigint as toxic_lost from s, t group by all)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r""",
    "op13_merkle_manifest": r"""
        with recursive f as (select doc_id, lang, n_chars, [case when v is null then '-' else octet_length(encode(v)) || ':' || v end for v in [doc_id::varchar, source, lang]] as head, case when text is null then '-' else octet_length(encode(text)) || ':' || text end as tail from documents),
        crc as (select doc_id, xor(list_reduce(list_prepend(4294967295, [ord(x)::bigint for x in string_split(doc_id::varchar, '')]), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)), 4294967295) as crc from f),
        g as (select f.*, sha256(array_to_string(head, '') || case when n_chars is null then '-' else len(n_chars::varchar) || ':' || n_chars end || tail) as leaf, sha256(array_to_string(head, '') || case when n_chars is null then '-' else len((n_chars + 1)::varchar) || ':' || (n_chars + 1) end || tail) as other from f),
        p as (select g.*, case when crc % 7 = 0 then other else leaf end as seen, row_number() over (partition by lang order by doc_id, leaf) - 1 as pos, count(*) over (partition by lang) as total, dense_rank() over (order by lang nulls first) - 1 as grp from g left join crc using (doc_id)),
        low as (select grp, 0 as level, pos, total, leaf as h from p union all select grp, level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(h, '' order by pos)) from low where total > 1 group by grp, level, pos // 2, total),
        sub as (select grp, h, max(level) as level from low where total = 1 group by all), n as (select count(*) as n from sub),
        high as (select 0 as level, grp as pos, n as total, h from sub, n union all select level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(h, '' order by pos)) from high where total > 1 group by level, pos // 2, total),
        nodes as (select grp, level, pos, h, case when total = 2 then grp else pos // 2 end as up from low where total > 1 union all select sub.grp, sub.level + high.level, high.pos, high.h, high.pos // 2 from high, sub where high.total > 1),
        pairs as (select *, coalesce(case when pos % 2 = 1 then lag(h) over w else lead(h) over w end, '') as beside from nodes window w as (partition by grp, level order by pos)),
        fold as (select doc_id, grp, 0::bigint as level, case when total > 1 then pos else grp end as pos, seen as h, '' as proof from p
          union all select f.doc_id, f.grp, f.level + 1, n.up, sha256(case when f.pos % 2 = 1 then n.beside || f.h else f.h || n.beside end), f.proof || n.beside from fold f join pairs n on n.grp = f.grp and n.level = f.level and n.pos = f.pos),
        done as (select doc_id, arg_max(h, level) as folded_root, sha256(arg_max(proof, level)) as proof_sha256 from fold group by 1)
        select doc_id, leaf, sub.h as subroot, r.h as root, proof_sha256, folded_root, folded_root = r.h as verified from p join done using (doc_id) join sub using (grp), (select h from high where total = 1) r""",
}
