"""The thin queries that apply each operator to its whole table, and SQL for those that it can express.

SQL has no tokenizer, trained model or codec, so ``op1``, ``op2``, ``op4``, ``op6``, ``op7`` and ``op9`` have none; of
``op5`` and ``op10`` it can express the columns that their contracts fix, which two further queries select.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .castore import op1_content_store
from .decontam import op9_decontamination
from .langid import op6_language_id
from .lexical import op12_lexical_search
from .minhash import op3_minhash_dedup
from .multiindex import op8_vector_dedup
from .ngram import op5_interpolated_lm
from .packing import op4_best_fit_packing
from .phrases import op11_collocations
from .quality import op2_quality_mil
from .repeats import op13_suffix_dedup
from .secretscan import op10_secret_scan
from .toxicity import op7_toxicity_crf


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op5`` counts, and its base score: all but the model's own score."""
    return op5_interpolated_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op10`` finds in the texts as they stand: all but the spans of decoded layers."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES = {
    q.__name__: q
    for q in (
        op1_content_store, op2_quality_mil, op3_minhash_dedup, op4_best_fit_packing, op5_interpolated_lm,
        op6_language_id, op7_toxicity_crf, op8_vector_dedup, op9_decontamination, op10_secret_scan,
        op11_collocations, op12_lexical_search, op13_suffix_dedup, language_model_base, secret_base,
    )
}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+')"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: Smallest id that each id reaches by links l(a, b).
_REACH = """both_ AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON e.a = r.b),
    least AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""
#: CRC-32 of an id as text, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda acc, x: list_reduce(list_transform(range(8), lambda k: CAST(k AS BIGINT)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END, xor(acc, x)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""
_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_FORMS = {
    "assign": f"({_KEY})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "access": "(AKIA)([A-Z0-9]{16,})",
    "hex": "([0-9a-f])([0-9a-f]{23,})",
}


def _found(kind: str, number: int, least: int) -> str:
    """Matches of one kind: what lies between them is as long as it must be to tell their places."""
    take = lambda group: f"regexp_extract_all(coalesce(text, ''), '(?s)(.*?)({_FORMS[kind]})', {group})"
    return f"""{kind}_ AS (SELECT doc_id, list_transform({take(1)}, lambda x: length(x)) AS gap, list_transform({take(2)}, lambda x: length(x)) AS size, list_transform({take(4)}, lambda x: length(x)) AS own FROM documents),
    {kind}s AS (SELECT doc_id, {number} AS kind, '{kind}' AS name, coalesce(list_sum(gap[:k]), 0) + coalesce(list_sum(size[:k - 1]), 0) AS start, size[k] AS size, own[k] AS own
        FROM (SELECT *, unnest(range(1, len(gap) + 1)) AS k FROM {kind}_)), {kind}f AS (SELECT * FROM {kind}s WHERE own >= {least})"""


ORACLE_SQL: dict[str, str] = {
    "op3_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
        u AS (SELECT doc_id, unnest(s) AS g FROM s), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)), {_REACH}
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM s LEFT JOIN least ON id = doc_id""",
    "op8_vector_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        g AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98), {_REACH},
        n AS (SELECT a AS id, count(*) AS n FROM both_ GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM e LEFT JOIN least ON least.id = vec_id LEFT JOIN n ON n.id = vec_id""",
    "op11_collocations": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p), i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        n AS (SELECT lang, count(*) AS n FROM i GROUP BY 1), g AS (SELECT lang, w[i:i + k - 1] AS g FROM i, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, array_to_string(g, ' ') AS x, any_value(g) AS g, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 10),
        c AS (SELECT lang, x, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
        s AS (SELECT c.lang, c.x, c.a, c.k, u.a AS l, v.a AS r, 1000000::HUGEINT * c.a * c.a // (u.a::HUGEINT * v.a) AS score FROM c JOIN f u ON u.lang = c.lang AND u.x = array_to_string(c.g[:c.k], ' ') JOIN f v ON v.lang = c.lang AND v.x = array_to_string(c.g[c.k + 1:], ' ')),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
        h AS (SELECT lang, x, max(a) AS most FROM (SELECT lang, array_to_string(g[:2], ' ') AS x, a FROM f WHERE len(g) = 3 UNION ALL SELECT lang, array_to_string(g[2:], ' '), a FROM f WHERE len(g) = 3) GROUP BY 1, 2),
        r AS (SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, encode(m.x)) AS rank, m.x AS phrase, a, l, r, score FROM m LEFT JOIN h ON h.lang = m.lang AND h.x = m.x WHERE most IS NULL OR 100 * most < 50 * a)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_lexical_search": f"""WITH d AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents), p AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
        a AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n), f AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY 1),
        q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM q JOIN f USING (t) JOIN p USING (t) JOIN n USING (doc_id), a GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
        SELECT item_id, k::INTEGER AS rank, doc_id, score FROM r WHERE k <= 50""",
    "op13_suffix_dedup": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM t),
        g AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY g) AS dup FROM (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x, CASE WHEN 2 * p + 100 <= len(h) THEN substr(h, 2 * p + 1, 100) END AS g FROM b)),
        r AS (SELECT doc_id, p, x, coalesce(p - max(CASE WHEN g IS NOT NULL AND dup THEN p END) OVER (PARTITION BY doc_id ORDER BY p) < 50, false) AS gone FROM g),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM r),
        s AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE first) AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone), ''))) AS kept_sha256 FROM e GROUP BY 1)
        SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM t LEFT JOIN s USING (doc_id)""",
    "language_model_base": f"""WITH w AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS}, '') AS w FROM documents), u AS (SELECT doc_id, held_out, unnest(w) AS t FROM w),
        c AS (SELECT t, count(*) AS c FROM u WHERE NOT held_out GROUP BY 1), n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
        SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
        FROM u LEFT JOIN c USING (t) CROSS JOIN n GROUP BY 1""",
    "secret_base": f"""WITH {_found("assign", 0, 6)}, {_found("access", 1, 0)}, {_found("hex", 2, 0)},
        f AS (SELECT * FROM assignf UNION ALL SELECT * FROM accessf UNION ALL SELECT * FROM hexf),
        g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS h,
            string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, kind) AS spans FROM f GROUP BY 1)
        SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
}
