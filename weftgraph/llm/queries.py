"""The operators as registered queries over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import chat, fim, jaccard, langid, leaks, mix, pages, phrases, place, quality, suffix, tokens, toxicity
from weftgraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_jaccard_components(spark, d):
    return jaccard.components(table(spark, d, "documents"), words=3, percent=90)


@query
def op2_language_id(spark, d):
    docs = table(spark, d, "documents")
    aside = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~aside))
    return langid.predict(docs, model).select("doc_id", aside.alias("held_out"), "lang_pred", "score")


@query
def op3_long_repeats(spark, d):
    return suffix.repeats(table(spark, d, "documents")).drop("kept")


@query
def op4_main_text(spark, d):
    return pages.main_text(table(spark, d, "pages"))


@query
def op5_chat_format(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L conv_id, t turn, r role, :x text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)", args={"x": hard})
    return chat.read_chats(chat.format_chats(turns.unionByName(extra)))


@query
def op6_mix_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_quality_rules(spark, d):
    return quality.verdicts(table(spark, d, "documents"), keep=["doc_id"], labels=table(spark, d, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_benchmark_leaks(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def tokenizer() -> str:
    """The tokenizer's file; PUBLIC_TOKENIZER names another place for it."""
    if named := os.environ.get("PUBLIC_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op9_token_files(spark, d):
    return tokens.token_files(table(spark, d, "documents"), tokenizer())


@query
def op10_place_documents(spark, d):
    shards = [f"shard-{i:03d}" for i in range(place.SHARDS)]
    return place.place(table(spark, d, "documents").select("doc_id"), "doc_id", shards)


@query
def op11_collocations(spark, d):
    return phrases.collocations(table(spark, d, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM pieces, (VALUES (1), (2), (3), (4), (5)) AS v(size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= 100
), named AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1
), inner_spots AS (
  SELECT lang, a, w, size, k, unnest(generate_series(1, size - k + 1)) AS i
  FROM named, (VALUES (2), (3), (4)) AS v(k) WHERE k < size
), held AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS inside FROM inner_spots GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:size], ' ') AS rest
  FROM (SELECT n.*, unnest(generate_series(1, size - 1)) AS k
        FROM named n LEFT JOIN held h USING (lang, phrase) WHERE h.inside IS NULL OR h.inside < a)
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


@query
def op12_toxicity(spark, d):
    docs = table(spark, d, "documents")
    aside = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, d, "labels").where(~aside))
    return toxicity.score(docs, model).select("doc_id", aside.alias("held_out"), "score", "predicted")


@query
def op13_fill_in_middle(spark, d):
    outputs = fim.transform(table(spark, d, "documents"))
    return fim.restore(outputs, with_text=False).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLES["op13_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), u AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(x, y)], '') AS prefix,
         array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(units[greatest(x, y) + 1:], '') AS suffix
  FROM u
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
