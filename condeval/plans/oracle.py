"""DuckDB statements that state the same results over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from condeval.operators.splitting import FIRST, GAMMA, SECOND
from condeval.plans.catalogue import ITEM_REPLICATES, PAIRS, REPLICATES

GRID = "[-4.78, -3.59, -2.39, -1.20, 0.0, 1.20, 2.39, 3.59, 4.78]::DOUBLE[]"


def _lines(rate: str = "l_discount", shift: int = 5) -> str:
    return f"""
    SELECT l_partkey AS item, CAST(round({rate} * 100) AS INT) - {shift} AS step,
           CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN NULL
                WHEN l_linenumber = 7 THEN 'UNPARSEABLE'
                WHEN l_returnflag = 'A' THEN 'FIGURATIVE'
                WHEN l_returnflag = 'R' THEN 'LITERAL'
                ELSE 'INCOHERENT' END AS label
    FROM lineitem"""


ITEMS = """
    SELECT p_partkey AS item, p_type AS category, p_brand AS expression, p_size <= 10 AS gold
    FROM part"""

SUITE = f"lines AS ({_lines()}), items AS ({ITEMS}), suite AS (SELECT * FROM lines JOIN items USING (item))"

RATES = """
    round_even(f / n, 3) AS "FIGURATIVE", round_even(l / n, 3) AS "LITERAL",
    round_even(i / n, 3) AS "INCOHERENT", round_even(f / n + l / n, 3) AS coherence_rate"""

TALLY = """
    CAST(count(label) AS DOUBLE) AS n, count(*) FILTER (label = 'FIGURATIVE') AS f,
    count(*) FILTER (label = 'LITERAL') AS l, count(*) FILTER (label = 'INCOHERENT') AS i"""

POOL = """
    SELECT p_partkey, p_name AS sentence, p_type AS idiom, split_part(p_name, ' ', 1) AS span,
           CASE WHEN p_size <= 15 THEN 'idiomatic' WHEN p_size <= 35 THEN 'literal' ELSE 'other' END AS usage
    FROM part"""

POOL_KEPT = f"""
    SELECT *, CASE usage WHEN 'idiomatic' THEN 'figurative' ELSE 'literal' END AS label
    FROM ({POOL}) WHERE usage IN ('idiomatic', 'literal') AND lower(span) = lower(idiom)"""

RATED = """
    SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'INCOHERENT' WHEN quality = 1 THEN 'FIGURATIVE'
                              WHEN quality = 0 THEN 'LITERAL' END AS human_label
    FROM documents LEFT JOIN labels USING (doc_id)"""

RATINGS = f"""
    pairs AS (
      SELECT human_label, CASE WHEN n_chars > 3000 THEN 'FIGURATIVE' WHEN n_chars > 500 THEN 'LITERAL'
                               ELSE 'INCOHERENT' END AS label
      FROM ({RATED}) JOIN documents USING (doc_id) WHERE human_label IS NOT NULL)"""

MERGED = r"""
    SELECT doc_id AS row_id, v1 AS verdict_1, CASE v1 WHEN 'INVALID' THEN flat END AS revision_1,
           v2 AS verdict_2, CASE v2 WHEN 'INVALID' THEN flat END AS revision_2,
           coalesce(v1 = v2, false) AS agree,
           CASE WHEN v1 = 'VALID' AND v2 = 'VALID' THEN 'keep' ELSE 'revise' END AS decision
    FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat,
                 CASE WHEN n_chars > 1000 THEN 'VALID' ELSE 'INVALID' END AS v1,
                 CASE WHEN quality = 1 THEN 'VALID' WHEN quality IS NOT NULL THEN 'INVALID' END AS v2
          FROM documents LEFT JOIN labels USING (doc_id))"""

# Elements as whole multiples of 2**-64, which single-precision numbers below 1 in size are unless they
# are tiny: sums of integers are exact. What is added in doubles is added in order of the place.
MEANS = """
    elements AS (SELECT coalesce(label = 0, false) AS positive, generate_subscripts(embedding, 1) - 1 AS place,
                        (unnest(embedding)::DOUBLE * 18446744073709551616::DOUBLE)::HUGEINT AS x FROM embeddings),
    sums AS (SELECT place, sum(x) FILTER (positive) AS x1, sum(x) FILTER (NOT positive) AS x0,
                    count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n0
             FROM elements GROUP BY place),
    means AS (SELECT place, x1::DOUBLE / 18446744073709551616::DOUBLE / n1 AS m1,
                     x0::DOUBLE / 18446744073709551616::DOUBLE / n0 AS m0, n1, n0 FROM sums),
    listed AS (SELECT list_reduce(list((m1 - m0) * (m1 - m0) ORDER BY place), lambda a, b: a + b, 0::DOUBLE) AS square,
                      list_reduce(list((m1 - m0) * (m1 + m0) ORDER BY place), lambda a, b: a + b, 0::DOUBLE) AS centre
               FROM means),
    whole AS (SELECT sqrt(square) AS s, centre / 2 / sqrt(square) AS midpoint FROM listed)"""


def _clusters(cluster: str) -> str:
    return f"""
    {SUITE},
    clusters AS (
      SELECT category, CAST({cluster} AS VARCHAR) AS cluster,
             count(*) FILTER (step = 0 AND label = 'LITERAL') AS k0, count(*) FILTER (step = 0) AS n0,
             count(*) FILTER (step = -5 AND label = 'LITERAL') AS k1, count(*) FILTER (step = -5) AS n1
      FROM suite GROUP BY ALL),
    indexed AS (
      SELECT *, row_number() OVER (PARTITION BY category ORDER BY substr(md5(cluster), 1, 3), cluster) - 1 AS ix,
             count(*) OVER (PARTITION BY category) AS n
      FROM clusters)"""


def _mixed(x: str) -> str:
    """The 64-bit mixing of ``condeval.operators.splitting``, as SQL."""
    times = "((xor(z, z >> {}))::UHUGEINT * {}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    first = f"list_transform([{x}], lambda z: {times.format(30, FIRST)})"
    second = f"list_transform({first}, lambda z: {times.format(27, SECOND)})"
    return f"list_transform({second}, lambda z: xor(z, z >> 31))[1]"


def _step(state: str, number: str) -> str:
    added = f"({state}::UHUGEINT + {GAMMA}::UHUGEINT * (({number}) + 1)::UHUGEINT) % 18446744073709551616::UHUGEINT"
    return _mixed(f"({added})::UBIGINT")


def _deltas(cluster: str, replicates: int) -> str:
    """Draws split down a binary tree of clusters: the ones among a node's hash bits go left."""
    word = _step("state", "i")
    left = f"""
        list_sum(list_transform(range((m + 63) // 64), lambda i:
          bit_count(({word} >> (64 - least(64, m - 64 * i))::UBIGINT)::HUGEINT)::BIGINT))::BIGINT"""
    return f"""
    {_clusters(cluster)},
    sizes AS (
      SELECT category, n, length(bin(n - 1)) - (n = 1)::INT AS top,
             ('0x' || substr(md5('0|' || category), 1, 16))::UBIGINT AS seed
      FROM (SELECT DISTINCT category, n FROM indexed)),
    tree AS (
      SELECT category, n, (1::BIGINT << top) AS leaves, replicate, {_step("seed", "replicate")} AS own,
             0::BIGINT AS round, 1::BIGINT AS node, n::BIGINT AS m
      FROM sizes, range({replicates}) r(replicate)
      UNION ALL
      SELECT category, n, leaves, replicate, own, sent.round, sent.node, sum(sent.m)::BIGINT
      FROM (
        SELECT category, n, leaves, replicate, own,
               unnest(CASE WHEN node < leaves THEN [{{'round': round, 'node': 2 * node, 'm': goes}},
                                                    {{'round': round, 'node': 2 * node + 1, 'm': m - goes}}]
                           WHEN node - leaves >= n THEN [{{'round': round + 1, 'node': 1::BIGINT, 'm': m}}]
                           ELSE [] END) AS sent
        FROM (SELECT *, CASE WHEN node < leaves THEN {left} ELSE 0 END AS goes
              FROM (SELECT *, {_step(_step("own", "round"), "node")} AS state FROM tree)))
      WHERE sent.m > 0 GROUP BY ALL),
    draws AS (SELECT category, replicate, node - leaves AS ix, m FROM tree WHERE node >= leaves AND node - leaves < n),
    deltas AS (
      SELECT category, replicate,
             sum(k1 * m) / nullif(sum(n1 * m), 0)::DOUBLE - sum(k0 * m) / nullif(sum(n0 * m), 0)::DOUBLE AS delta
      FROM draws JOIN indexed USING (category, ix) GROUP BY ALL)"""


def _drawn_deltas(cluster: str, replicates: int) -> str:
    """The draws made one by one."""
    return f"""
    {_clusters(cluster)},
    draws AS (
      SELECT category, replicate,
             ('0x' || substr(md5('0|' || category || '|' || replicate || '|' || slot // 2), 1 + 16 * (slot % 2)::INT, 15))::BIGINT % n AS ix
      FROM (SELECT DISTINCT category, n FROM indexed), range({replicates}) r(replicate),
           LATERAL (SELECT unnest(range(n)) AS slot)),
    deltas AS (
      SELECT category, replicate,
             sum(k1) / nullif(sum(n1), 0)::DOUBLE - sum(k0) / nullif(sum(n0), 0)::DOUBLE AS delta
      FROM draws JOIN indexed USING (category, ix) GROUP BY ALL)"""


def _intervals(cluster: str, replicates: int, deltas: Callable[[str, int], str] = _deltas) -> str:
    return f"""
        WITH RECURSIVE {deltas(cluster, replicates)},
        points AS (SELECT category, count(*) AS n_groups,
                     sum(k1) / nullif(sum(n1), 0)::DOUBLE - sum(k0) / nullif(sum(n0), 0)::DOUBLE AS delta
                   FROM clusters GROUP BY category),
        spread AS (SELECT category, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi,
                          count(*) - count(delta) AS n_undefined FROM deltas GROUP BY category)
        SELECT category AS name, n_groups, round(delta, 6) AS delta,
               CASE WHEN n_undefined = 0 THEN round(lo, 6) END AS ci_lo,
               CASE WHEN n_undefined = 0 THEN round(hi, 6) END AS ci_hi, n_undefined
        FROM points JOIN spread USING (category)"""


_PAIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)

VOTES = """
    CASE WHEN 2 * f > n THEN 'FIGURATIVE' WHEN 2 * l > n THEN 'LITERAL'
         WHEN 2 * i > n THEN 'INCOHERENT' WHEN 2 * u > n THEN 'UNPARSEABLE' END"""

UNKNOWN = "count(*) FILTER (label NOT IN ('FIGURATIVE', 'LITERAL', 'INCOHERENT', 'UNPARSEABLE'))"
VOTE_TALLY = f"{TALLY}, count(*) FILTER (label = 'UNPARSEABLE') AS u, {UNKNOWN} AS odd"

ORACLE: dict[str, str] = {
    "q01_profile": """
        WITH j AS (SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
        SELECT "column", value, count(*) AS n FROM (
          SELECT 'lang' AS "column", lang AS value FROM j
          UNION ALL SELECT 'source', source FROM j
          UNION ALL SELECT 'quality', CAST(quality AS VARCHAR) FROM j
          UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM j)
        WHERE value IS NOT NULL GROUP BY ALL""",
    "q02_contrast_pool": POOL_KEPT,
    "q03_condition_grid": f"""
        SELECT s_suppkey, coefficient, sample_i::INT AS sample_i
        FROM supplier, unnest({GRID}) g(coefficient), range(5) r(sample_i)""",
    "q04_pending_conditions": """
        SELECT p_partkey AS item, step::DOUBLE AS coefficient
        FROM part, range(-5, 6) r(step)
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey
                          AND round(l_discount * 100) - 5 = step)""",
    "q05_pending_rows": """
        SELECT doc_id, lang, source, n_chars FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "q06_prompt_render": """
        SELECT doc_id, concat('Passage in ', lang, ' from ', source, ': "', text,
                              '"', chr(10), 'Answer with one of {FIGURATIVE, LITERAL}.') AS prompt
        FROM documents""",
    "q07_label_parse": r"""
        WITH answers AS (
          SELECT doc_id, CASE n_chars % 6
            WHEN 0 THEN '<think>' || text || ' literal</think>' || chr(10) || 'Final label: figurative'
            WHEN 1 THEN text || ' it is literally figurative'
            WHEN 2 THEN text || chr(10) || 'FINAL LABEL: <FIGURATIVE>'
            WHEN 3 THEN '' WHEN 4 THEN text ELSE '<think> LITERAL ' || text END AS answer
          FROM documents),
        plain AS (SELECT doc_id, upper(trim(regexp_replace(answer, '<think>.*?</think>', '', 'gs'))) AS a FROM answers),
        stated AS (SELECT doc_id, a,
                     regexp_extract(a, 'FINAL\s*LABEL\s*:\s*(FIGURATIVE|LITERAL|INCOHERENT)', 1) AS final FROM plain)
        SELECT doc_id, CASE WHEN final <> '' THEN final WHEN contains(a, 'INCOHERENT') THEN 'INCOHERENT'
                            WHEN contains(a, 'LITERAL') THEN 'LITERAL'
                            WHEN contains(a, 'FIGURATIVE') THEN 'FIGURATIVE' ELSE 'UNPARSEABLE' END AS label
        FROM stated""",
    "q08_span_end_token": r"""
        WITH words AS (SELECT doc_id, text, source, regexp_split_to_array(text, '\s+') AS w FROM documents),
        picked AS (SELECT doc_id, text, source, w[len(w) // 2 + 1] AS one, w[len(w) // 2 + 2] AS next FROM words),
        spans AS (
          SELECT doc_id, text, 'word' AS kind, translate(one, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS span FROM picked
          UNION ALL SELECT doc_id, text, 'words', one || ' ' || next FROM picked
          UNION ALL SELECT doc_id, text, 'source', source FROM picked
          UNION ALL SELECT doc_id, text, 'empty', '' FROM picked),
        hits AS (SELECT *, lower(text) AS t, length(lower(span)) AS n,
                        strpos(lower(text), lower(span)) AS hit FROM spans)
        SELECT doc_id, kind, CASE WHEN hit > 0 THEN hit::INT WHEN span = '' THEN 1 END AS start,
               CASE WHEN hit > 0 AND n > 0
                    THEN len(regexp_extract_all(substr(t, 1, hit + n - 1), '\S+'))::INT - 1 END AS token
        FROM hits""",
    "q09_rates_by_step": f"""
        SELECT step, {RATES} FROM (SELECT step, {TALLY} FROM ({_lines()}) WHERE label IS NOT NULL GROUP BY step)""",
    "q10_rates_grouping_sets": f"""
        WITH {SUITE}
        SELECT pooled, category, step, {RATES} FROM (
          SELECT grouping(category) = 1 AS pooled, category, step, {TALLY} FROM suite WHERE label IS NOT NULL
          GROUP BY GROUPING SETS ((step), (category, step)))""",
    "q11_gold_rates": f"""
        WITH {SUITE}
        SELECT step, {RATES} FROM (SELECT step, {TALLY} FROM suite WHERE gold AND label IS NOT NULL GROUP BY step)""",
    "q12_combined_by_step": f"""
        WITH a AS (SELECT step, {RATES} FROM (
               SELECT step, {TALLY} FROM ({_lines()}) WHERE label IS NOT NULL GROUP BY step)),
             b AS (SELECT step, {RATES} FROM (
               SELECT step, {TALLY} FROM ({_lines("l_tax", 4)}) WHERE label IS NOT NULL GROUP BY step))
        SELECT step, a."LITERAL" AS discount_literal_rate, b."LITERAL" AS tax_literal_rate,
               a.coherence_rate AS discount_coherence_rate, b.coherence_rate AS tax_coherence_rate
        FROM a FULL JOIN b USING (step)""",
    "q13_delta_vs_baseline": f"""
        WITH {SUITE}, sides AS (
          SELECT category,
                 avg(CASE WHEN label = 'LITERAL' THEN 1 ELSE 0 END) FILTER (step = 0) AS base,
                 avg(CASE WHEN label = 'LITERAL' THEN 1 ELSE 0 END)
                   FILTER (step = (SELECT min(step) FROM lines)) AS pushed
          FROM suite GROUP BY category)
        SELECT category, round(base, 6) AS baseline_rate, round(pushed, 6) AS pushed_rate,
               round(pushed - base, 6) AS delta FROM sides""",
    "q14_dose_response": f"""
        WITH {SUITE},
        rates AS (SELECT category, step, {RATES} FROM (
          SELECT category, step, {TALLY} FROM suite WHERE label IS NOT NULL GROUP BY ALL)),
        based AS (SELECT r.*, b."LITERAL" AS base FROM rates r LEFT JOIN rates b
                  ON b.category = r.category AND b.step = 0),
        peaks AS (SELECT category, step AS peak FROM rates
                  QUALIFY row_number() OVER (PARTITION BY category ORDER BY "LITERAL" DESC, step) = 1)
        SELECT category, any_value(base) AS baseline_rate,
               bool_and("LITERAL" > base) FILTER (step < 0) AS negatives_above,
               bool_and("LITERAL" <= base) FILTER (step > 0) AS positives_not_above,
               any_value(peak) AS peak, max("LITERAL") AS peak_rate, min(coherence_rate) AS min_coherence_rate
        FROM based JOIN peaks USING (category) GROUP BY category""",
    "q15_first_per_category": """
        SELECT p_type, p_partkey, p_brand, p_size <= 10 AS gold FROM part
        QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size <= 10 DESC, p_partkey) = 1""",
    "q16_majority_label": f"""
        WITH {SUITE}
        SELECT expression, step, n::BIGINT AS n_labelled, odd AS n_unknown, {VOTES} AS majority
        FROM (SELECT expression, step, {VOTE_TALLY} FROM suite GROUP BY ALL)""",
    "q17_label_flips": f"""
        WITH {SUITE},
        votes AS (SELECT item, step, {VOTES} AS majority FROM (
          SELECT item, step, {VOTE_TALLY} FROM lines WHERE step IN (0, -5) GROUP BY ALL)),
        sides AS (SELECT item, max(majority) FILTER (step = 0) AS base, max(majority) FILTER (step = -5) AS pushed
                  FROM votes GROUP BY item),
        flips AS (SELECT *, coalesce(base = 'FIGURATIVE' AND pushed = 'LITERAL', false) AS flipped
                  FROM sides JOIN items USING (item))
        SELECT grouping(category) = 1 AS pooled, category, count(*) AS n_items,
               count(*) FILTER (base IS NOT NULL AND pushed IS NOT NULL) AS n_comparable,
               count(*) FILTER (flipped) AS n_flips, count(DISTINCT expression) FILTER (flipped) AS n_expressions
        FROM flips GROUP BY GROUPING SETS ((), (category))""",
    "q18_rater_agreement": f"""
        WITH {RATINGS},
        h AS (SELECT human_label AS v, count(*) AS h FROM pairs GROUP BY ALL),
        j AS (SELECT label AS v, count(*) AS j FROM pairs GROUP BY ALL),
        t AS (SELECT count(*) AS n_pairs, count(*) FILTER (human_label = label) AS n_agree FROM pairs),
        p AS (SELECT n_pairs, n_agree, n_agree / n_pairs AS po,
                     (SELECT sum(h * j) FROM h JOIN j USING (v)) / (n_pairs * n_pairs)::DOUBLE AS pe FROM t)
        SELECT n_pairs, n_agree, round(po, 6) AS po, round(pe, 6) AS pe,
               round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM p""",
    "q19_confusion_rates": f"""
        WITH {RATINGS}
        SELECT human_label, label, count(*) AS n,
               round(count(*) / sum(count(*)) OVER (PARTITION BY human_label), 6) AS rate
        FROM pairs GROUP BY human_label, label""",
    "q20_annotator_merge": MERGED,
    "q21_direction": f"""
        WITH {MEANS}
        SELECT place::INT AS place, (m1 - m0) / s AS v, s, midpoint,
               n1 AS n_positive, n0 AS n_other FROM means, whole""",
    "q22_shift_sweep": f"""
        WITH {MEANS},
        unit AS (SELECT place, (m1 - m0) / s AS v FROM means, whole),
        rows AS (SELECT vec_id, label AS class, generate_subscripts(embedding, 1) - 1 AS place,
                        unnest(embedding)::DOUBLE AS x FROM embeddings),
        projected AS (SELECT vec_id, class, sum(x * v) AS p FROM rows JOIN unit USING (place) GROUP BY ALL),
        cells AS (SELECT class, coefficient, CASE WHEN p + coefficient * s > midpoint THEN 'FIGURATIVE'
                                                  ELSE 'LITERAL' END AS label
                  FROM projected, whole, unnest({GRID}) g(coefficient))
        SELECT class AS label, coefficient, {RATES}
        FROM (SELECT class, coefficient, {TALLY} FROM cells GROUP BY ALL)""",
    "q23_bootstrap_ci": _intervals("expression", REPLICATES),
    "q24_bootstrap_pairwise": f"""
        WITH RECURSIVE {_deltas("expression", REPLICATES)},
        pairs(a, b) AS (VALUES {_PAIR_ROWS}),
        diffs AS (SELECT a || ' vs ' || b AS pair, x.delta - y.delta AS diff
                  FROM pairs JOIN deltas x ON x.category = a
                  JOIN deltas y ON y.category = b AND y.replicate = x.replicate),
        spread AS (SELECT pair, avg(diff) AS diff, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi,
                          count(*) - count(diff) AS n_undefined FROM diffs GROUP BY pair)
        SELECT pair, CASE WHEN n_undefined = 0 THEN round(diff, 6) END AS diff,
               CASE WHEN n_undefined = 0 THEN round(lo, 6) END AS ci_lo,
               CASE WHEN n_undefined = 0 THEN round(hi, 6) END AS ci_hi,
               CASE WHEN n_undefined = 0 THEN NOT (lo <= 0 AND 0 <= hi) END AS distinguishable, n_undefined
        FROM spread""",
    "q25_suite_invariants": """
        WITH keys AS (
          SELECT split_part(p_name, ' ', -1) AS expression, p_size, count(*) AS rows,
                 count(*) FILTER (p_size <= 10) AS trusted,
                 count(*) FILTER (NOT ends_with(p_name, split_part(p_name, ' ', -1))) AS loose
          FROM part GROUP BY ALL)
        SELECT expression, count(*) AS n_variants, sum(trusted)::BIGINT AS n_gold,
               count(*) FILTER (rows > 1) AS n_repeated_keys, sum(loose)::BIGINT AS n_loose_prefixes,
               count(*) = 5 AND sum(trusted) = 1 AND count(*) FILTER (rows > 1) = 0 AND sum(loose) = 0 AS holds
        FROM keys GROUP BY expression""",
    "q26_batch_label": """
        SELECT doc_id, lang, source, n_chars,
               CASE WHEN often >= length(text) THEN 'LITERAL' WHEN often > 0 THEN 'FIGURATIVE'
                    ELSE 'UNPARSEABLE' END AS label
        FROM (SELECT *, (length(text) - length(replace(text, 'the', ''))) // 3 * 100 AS often FROM documents)""",
    "q27_batch_generate": f"""
        SELECT s_suppkey, coefficient, sample_i::INT AS sample_i, continuation, s_name || continuation AS sentence
        FROM (SELECT *, printf(' [%+.2f] %d #%d', coefficient, length(s_name), sample_i) AS continuation
              FROM supplier, unnest({GRID}) g(coefficient), range(5) r(sample_i))""",
    "q28_table_shape": """
        SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_doc_id, count(DISTINCT lang) AS n_lang,
               count(DISTINCT source) AS n_source, count(*) FILTER (toxic = 1) AS n_true_flag
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "q29_categories": "SELECT DISTINCT p_type FROM part",
    "q30_class_balance": f"""
        SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM ({POOL_KEPT}) GROUP BY label""",
    "q31_rounded_deltas": f"""
        WITH {SUITE},
        rates AS (SELECT pooled, category, step, {RATES} FROM (
          SELECT grouping(category) = 1 AS pooled, category, step, {TALLY} FROM suite WHERE label IS NOT NULL
          GROUP BY GROUPING SETS ((step), (category, step)))),
        found AS (SELECT pooled, category, max("LITERAL") FILTER (step = 0) AS baseline_rate,
                         max("LITERAL") FILTER (step = (SELECT min(step) FROM lines)) AS pushed_rate
                  FROM rates GROUP BY ALL),
        deltas AS (SELECT *, pushed_rate - baseline_rate AS delta FROM found)
        SELECT pooled, category, baseline_rate, pushed_rate, round(delta, 6) AS delta,
               round(delta / nullif((SELECT delta FROM deltas WHERE pooled), 0), 6) AS ratio FROM deltas""",
    "q32_majority_per_item": f"""
        SELECT item, step, n::BIGINT AS n_labelled, odd AS n_unknown, {VOTES} AS majority
        FROM (SELECT item, step, {VOTE_TALLY} FROM ({_lines()}) GROUP BY ALL)""",
    "q33_rating_coverage": f"""
        SELECT lang, count(*) AS n_rows, count(human_label) AS n_rated FROM ({RATED}) GROUP BY lang""",
    "q34_verdict_agreement": f"""
        SELECT count(*) AS n_rows, count(*) FILTER (agree) AS n_agree,
               round(count(*) FILTER (agree) / count(*), 6) AS agreement,
               count(*) FILTER (decision = 'keep') AS n_keep FROM ({MERGED})""",
    "q35_annotator_summary": f"""
        SELECT annotator, count(*) FILTER (v = 'VALID') AS n_valid, count(*) FILTER (v = 'INVALID') AS n_flagged,
               count(*) AS n_total
        FROM (SELECT 1 AS annotator, verdict_1 AS v FROM ({MERGED})
              UNION ALL SELECT 2, verdict_2 FROM ({MERGED}) WHERE verdict_2 IS NOT NULL)
        GROUP BY annotator""",
    "q36_first_rows": "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size, p_partkey LIMIT 5",
    "q37_literal_rate": f"""
        WITH {SUITE}
        SELECT category, round(count(*) FILTER (label = 'LITERAL') / count(*), 6) AS literal_rate
        FROM suite GROUP BY category""",
    "q38_shifted_vectors": f"""
        WITH {MEANS},
        rows AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS place,
                        unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT vec_id, place::INT AS place, round(x + -2.39 * s * ((m1 - m0) / s), 6) AS x
        FROM rows JOIN means USING (place), whole""",
    "q39_comparison_deltas": f"""
        WITH {SUITE},
        tallies AS (
          SELECT 'all' AS series, step, {TALLY} FROM lines GROUP BY ALL
          UNION ALL SELECT 'suite', step, {TALLY} FROM suite GROUP BY ALL
          UNION ALL SELECT 'gold', step, {TALLY} FROM suite WHERE gold GROUP BY ALL
          UNION ALL SELECT category, step, {TALLY} FROM suite GROUP BY ALL),
        rates AS (SELECT series, step, round_even(l / n, 3) AS rate FROM tallies WHERE n > 0),
        found AS (SELECT series, max(rate) FILTER (step = 0) AS baseline_rate,
                         max(rate) FILTER (step = (SELECT min(step) FROM lines)) AS pushed_rate
                  FROM rates GROUP BY series)
        SELECT series, baseline_rate, pushed_rate, round(pushed_rate - baseline_rate, 6) AS delta,
               printf('%+.3f', pushed_rate - baseline_rate) AS shown FROM found""",
    "q40_flipped_items": f"""
        WITH votes AS (SELECT item, step, {VOTES} AS majority FROM (
               SELECT item, step, {VOTE_TALLY} FROM ({_lines()}) WHERE step IN (0, -5) GROUP BY ALL)),
        sides AS (SELECT item, max(majority) FILTER (step = 0) AS base, max(majority) FILTER (step = -5) AS pushed
                  FROM votes GROUP BY item)
        SELECT item, base AS majority_base, pushed AS majority_push,
               base IS NOT NULL AND pushed IS NOT NULL AS comparable,
               coalesce(base = 'FIGURATIVE' AND pushed = 'LITERAL', false) AS flipped FROM sides""",
    "q41_cluster_index": f"""
        WITH {_clusters("item")}
        SELECT category AS series, ix, n AS n_clusters, k0, n0, k1, n1 FROM indexed""",
    "q42_bootstrap_items": _intervals("item", ITEM_REPLICATES),
    "q43_bootstrap_drawn": _intervals("expression", REPLICATES, _drawn_deltas),
}
ORACLE["q44_label_once"] = ORACLE["q26_batch_label"]
ORACLE["q45_open_majority"] = """
    WITH rows AS (SELECT l_partkey AS item, CAST(round(l_discount * 100) AS INT) - 5 AS step,
                         l_returnflag || l_linenumber AS label FROM lineitem),
    counts AS (SELECT item, step, label, count(label) AS c FROM rows GROUP BY ALL)
    SELECT item, step, sum(c)::BIGINT AS n_labelled, max(label) FILTER (2 * c > whole) AS majority
    FROM (SELECT *, sum(c) OVER (PARTITION BY item, step) AS whole FROM counts) GROUP BY item, step"""
