"""SQL for DuckDB that answers the queries independently."""

from __future__ import annotations

import numpy as np

CELLS, ROUNDS, PQ_M, PQ_K, DIM, K = 8, 3, 4, 16, 64, 10

_BASE = """usable AS (
  SELECT doc_id, any_value(CAST(doc_vectors AS DOUBLE[])) AS x FROM doc_vectors_w2v
  WHERE doc_vectors IS NOT NULL AND len(doc_vectors) = 64 AND doc_id IS NOT NULL
    AND len(list_filter(doc_vectors, lambda e: e IS NULL OR isnan(e))) = 0 AND len(list_filter(doc_vectors, lambda e: e <> 0)) > 0
  GROUP BY doc_id),
 docs AS MATERIALIZED (SELECT doc_id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)))) AS v FROM usable)"""


def _sql(select: str, *ctes: str, base: bool = True) -> str:
    parts = ([_BASE] if base else []) + list(ctes)
    return f"WITH {', '.join(parts)} {select}" if parts else select


def _ranked(score: str, name: str, k: int = K, descending: bool = False, docs: str = "docs", where: str = "", qv: str = "qv", v: str = "v") -> str:
    order = "score DESC" if descending else "score"
    return f"""{name} AS MATERIALIZED (SELECT qid, rank, doc_id, score FROM (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM (SELECT qid, doc_id, round({score.format(q=qv, v=v)}, 6) + 0.0 AS score FROM {docs}, queries {where})) WHERE rank <= {k})"""


_L2, _DOT = "list_distance({v}, {q})", "list_inner_product({v}, {q})"
_COS = "list_inner_product({v}, {q}) / (sqrt(list_inner_product({v}, {v})) * sqrt(list_inner_product({q}, {q})))"
_TRUTH = _ranked(_L2, "truth")
_HALF = _ranked(_L2, "half", qv="qv[1:32]", v="v[1:32]")


def _mean_list(source: str, keys: str, v: str) -> str:
    return f"SELECT {keys}, list(a ORDER BY i) AS cv FROM (SELECT {keys}, i, avg(x) AS a FROM (SELECT {keys}, unnest({v}) AS x, generate_subscripts({v}, 1) AS i FROM {source}) GROUP BY {keys}, i) GROUP BY {keys}"


def _lloyd(source: str, name: str, k: int, rounds: int) -> list[str]:
    """CTEs {name}_c{t}(sub, cid, cv) and {name}_a{t}(doc_id, sub, v, cid) over source(doc_id, sub, v); the last is {name}_c / {name}_a."""
    ctes = [f"{name}_c0 AS MATERIALIZED (SELECT sub, CAST(r - 1 AS INTEGER) AS cid, v AS cv FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY doc_id) AS r FROM {source}) WHERE r <= {k})"]
    for t in range(rounds + 1):
        ctes.append(f"""{name}_a{t} AS MATERIALIZED (SELECT doc_id, sub, v, cid FROM (
  SELECT doc_id, s.sub, v, cid, row_number() OVER (PARTITION BY doc_id, s.sub ORDER BY round(power(list_distance(v, cv), 2), 9), cid) AS r FROM {source} s JOIN {name}_c{t} c ON s.sub = c.sub) WHERE r = 1)""")
        if t < rounds:
            ctes.append(f"{name}_c{t + 1} AS MATERIALIZED ({_mean_list(f'{name}_a{t}', 'sub, cid', 'v')})")
    ctes += [f"{name}_c AS (SELECT * FROM {name}_c{rounds})", f"{name}_a AS (SELECT * FROM {name}_a{rounds})"]
    return ctes


_WHOLE = "whole AS (SELECT doc_id, 0 AS sub, v FROM docs)"
_IVF = [_WHOLE, *_lloyd("whole", "km", CELLS, ROUNDS)]
_PROBE = "probe AS MATERIALIZED (SELECT qid, qv, cid, cv, d2, probe_rank FROM (SELECT qid, qv, cid, cv, power(list_distance(qv, cv), 2) AS d2, row_number() OVER (PARTITION BY qid ORDER BY round(power(list_distance(qv, cv), 2), 9), cid) AS probe_rank FROM queries, km_c))"


def _probed(n: int, score: str = _L2, name: str = "near") -> str:
    s = score.format(q="qv", v="v")
    return f"""{name} AS (SELECT qid, rank, doc_id, score FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM (SELECT p.qid, a.doc_id, round({s}, 6) AS score FROM probe p JOIN km_a a ON a.cid = p.cid WHERE probe_rank <= {n})) WHERE rank <= {K})"""


def _parts(source: str, name: str, m: int = PQ_M) -> str:
    w = DIM // m
    return f"{name} AS MATERIALIZED (SELECT doc_id, CAST(s AS INTEGER) AS sub, v[s * {w} + 1 : s * {w} + {w}] AS v FROM {source}, range({m}) r(s))"


_PQ = [_parts("docs", "part"), *_lloyd("part", "pq", PQ_K, ROUNDS)]
_QPART = f"qpart AS (SELECT qid, CAST(s AS INTEGER) AS sub, qv[s * {DIM // PQ_M} + 1 : s * {DIM // PQ_M} + {DIM // PQ_M}] AS qs FROM queries, range({PQ_M}) r(s))"
_ADC = "adc AS MATERIALIZED (SELECT qid, c.sub, cid, power(list_distance(qs, cv), 2) AS d2 FROM qpart q JOIN pq_c c ON q.sub = c.sub)"
_RESIDUAL = "rest AS (SELECT a.doc_id, list_transform(list_zip(a.v, c.cv), lambda p: p[1] - p[2]) AS v, a.cid AS cell FROM km_a a JOIN km_c c ON a.cid = c.cid)"


def _planes(planes: np.ndarray) -> str:
    rows = ", ".join(f"({j}, [{', '.join(map(repr, map(float, w)))}])" for j, w in enumerate(planes))
    return f"plane(j, w) AS (VALUES {rows})"


def _bits(source: str, key: str, v: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {key}, j, CASE WHEN list_inner_product(CAST({v} AS DOUBLE[]), CAST(w AS DOUBLE[])) >= 0 THEN 1 ELSE 0 END AS bit FROM {source}, plane)"


def _banded(b: int, m: int = 128) -> list[str]:
    r = m // b
    return [f"db{b} AS MATERIALIZED (SELECT doc_id, j // {r} AS band, string_agg(bit, '' ORDER BY j) AS key FROM dbit GROUP BY 1, 2)", f"qb{b} AS (SELECT qid, j // {r} AS band, string_agg(bit, '' ORDER BY j) AS key FROM qbit GROUP BY 1, 2)", f"cand{b} AS MATERIALIZED (SELECT DISTINCT qid, doc_id FROM db{b} JOIN qb{b} USING (band, key))"]


def _cosine_top(cand: str, k: int = K) -> str:
    s = _COS.format(q="qv", v="v")
    return f"""SELECT qid, rank, doc_id, score FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM (SELECT qid, doc_id, round({s}, 6) AS score FROM {cand} JOIN docs USING (doc_id) JOIN queries USING (qid))) WHERE rank <= {k}"""


def _hash_ctes(planes: np.ndarray) -> list[str]:
    return [_planes(planes), _bits("docs", "doc_id", "v", "dbit"), _bits("queries", "qid", "qv", "qbit")]


_WORDS = r"word AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]+')) AS w FROM documents)"
_JOINED = "coalesce(list_aggregate({w}, 'string_agg', ' '), '')"
_METHOD = "regexp_replace(upper(trim(method)), '[_ ]+', '-', 'g')"
_HIT = "hit AS (SELECT h.qid, h.rank, t.rank AS truth_rank FROM half h JOIN truth t USING (qid, doc_id))"
_PER_QUERY = """q AS (SELECT DISTINCT qid FROM truth),
 inside AS (SELECT qid, count(*) AS n, sum(1 / log2(rank + 1)) AS dcg FROM hit WHERE rank <= 10 AND truth_rank <= 10 GROUP BY qid),
 running AS (SELECT qid, rank, count(*) OVER (PARTITION BY qid ORDER BY rank) AS seen FROM hit),
 ap AS (SELECT qid, sum(seen / rank) AS precisions, count(*) AS found, min(rank) AS first FROM running GROUP BY qid),
 ideal AS (SELECT sum(1 / log2(i + 1)) AS idcg FROM range(1, 11) r(i)),
 each AS (SELECT qid, round(coalesce(n, 0) / 10, 6) AS precision_at_k, round(coalesce(n, 0) / 10, 6) AS recall_at_k, round(coalesce(n, 0) / 10, 6) AS f1_at_k, round(coalesce(dcg / idcg, 0), 6) AS ndcg_at_k,
   round(coalesce(precisions / found, 0), 6) AS average_precision, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(precisions / 10, 0), 6) AS standard FROM q LEFT JOIN inside USING (qid) LEFT JOIN ap USING (qid), ideal)"""
_CURVE = """curve AS MATERIALIZED (SELECT h.qid, h.rank AS k, CAST(sum(CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY h.qid ORDER BY h.rank) AS BIGINT) AS hits, CAST(10 AS BIGINT) AS relevant
  FROM half h LEFT JOIN truth t ON h.qid = t.qid AND h.doc_id = t.doc_id)"""
_SUMMARY = "SELECT round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS greatest, CAST(sum(n) AS BIGINT) AS total FROM"


def oracle_sql() -> dict[str, str]:
    from quillvec.functions.text import STOP_WORDS
    from quillvec.operators.experiments import sample_ids
    from quillvec.operators.lsh import hyperplanes, table_hyperplanes

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    m128, m32, h60 = _hash_ctes(hyperplanes(DIM, 128)), _hash_ctes(hyperplanes(DIM, 32)), _hash_ctes(hyperplanes(DIM, 60))
    tables = _hash_ctes(table_hyperplanes(DIM, 8, 10).reshape(-1, DIM))
    keys = ["dk AS MATERIALIZED (SELECT doc_id, CAST(j // 8 AS INTEGER) AS tbl, CAST(sum(bit * power(2, 7 - j % 8)) AS BIGINT) AS key FROM dbit GROUP BY 1, 2)", "qk AS (SELECT qid, CAST(j // 8 AS INTEGER) AS tbl, CAST(sum(bit * power(2, 7 - j % 8)) AS BIGINT) AS key FROM qbit GROUP BY 1, 2)", "cand AS MATERIALIZED (SELECT DISTINCT qid, doc_id FROM dk JOIN qk USING (tbl, key))"]
    judged = [_TRUTH, _HALF, _HIT, _PER_QUERY]
    sweep = ", ".join(_probed(n, name=f"near{n}") for n in (1, 2, 5))
    def ivfpq(cells: list[str], codes: int, n: int) -> list[str]:
        return [*cells, _PROBE, _RESIDUAL, _parts("rest", "rpart"), *_lloyd("rpart", "rq", codes, ROUNDS), _parts(f"(SELECT p.qid * 100 + p.cid AS doc_id, p.qid, p.cid AS cell, list_transform(list_zip(qv, cv), lambda p: p[1] - p[2]) AS v FROM probe p WHERE probe_rank <= {n})", "qrest").replace("SELECT doc_id,", "SELECT qid, cell,"), "tab AS MATERIALIZED (SELECT qid, cell, c.sub, cid, power(list_distance(q.v, cv), 2) AS d2 FROM qrest q JOIN rq_c c ON q.sub = c.sub)"]
    residual_sums = "SELECT t.qid, a.doc_id, round(sum(d2), 6) AS score FROM tab t JOIN rest r ON r.cell = t.cell JOIN rq_a a ON a.doc_id = r.doc_id AND a.sub = t.sub AND a.cid = t.cid GROUP BY 1, 2"
    top = "SELECT qid, rank, doc_id, score FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, doc_id) AS INTEGER) AS rank, doc_id, score FROM ({}))  WHERE rank <= 10"
    hit_gain = "round(avg(coalesce(n, 0) / 10), 6) AS recall_at_k, round(avg(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i))), 6) AS ndcg_at_k"

    def judge(setting: str, every: str) -> str:
        """Means over the truth's queries of the lists `every` (a select of {setting}, qid, rank, doc_id)."""
        return f"every AS MATERIALIZED ({every}), got AS (SELECT {setting}, e.qid, count(*) AS n, sum(1 / log2(e.rank + 1)) AS dcg FROM every e JOIN truth t ON t.qid = e.qid AND t.doc_id = e.doc_id GROUP BY 1, 2), judged AS (SELECT s.{setting}, {hit_gain} FROM (SELECT DISTINCT {setting} FROM every) s CROSS JOIN (SELECT DISTINCT qid FROM truth) q LEFT JOIN got g ON g.{setting} = s.{setting} AND g.qid = q.qid GROUP BY 1)"

    def flat(cells: int) -> list[str]:
        return [_WHOLE, *_lloyd("whole", "km", cells, ROUNDS), _PROBE, ", ".join(_probed(n, name=f"near{n}") for n in (1, 2, 5, 10, 20)), _TRUTH, judge("n_probes", " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS n_probes, qid, rank, doc_id FROM near{n}" for n in (1, 2, 5, 10, 20)))]

    def quantised(m: int) -> list[str]:
        w = DIM // m
        return [_parts("docs", f"part{m}", m), *_lloyd(f"part{m}", f"pq{m}", 256, ROUNDS), f"adc{m} AS MATERIALIZED (SELECT qid, c.sub, cid, power(list_distance(qs, cv), 2) AS d2 FROM (SELECT qid, CAST(s AS INTEGER) AS sub, qv[s * {w} + 1 : s * {w} + {w}] AS qs FROM queries, range({m}) r(s)) q JOIN pq{m}_c c ON q.sub = c.sub)", f"near_{m} AS MATERIALIZED (SELECT qid, rank, doc_id, score FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, doc_id) AS INTEGER) AS rank, doc_id, score FROM (SELECT qid, doc_id, round(sum(d2), 6) AS score FROM adc{m} a JOIN pq{m}_a p ON p.sub = a.sub AND p.cid = a.cid GROUP BY qid, doc_id)) WHERE rank <= 10)"]

    def bits_near(n: int) -> list[str]:
        return [c.replace("plane(j, w)", f"plane{n}(j, w)").replace("dbit AS", f"dbit{n} AS").replace("qbit AS", f"qbit{n} AS").replace(", plane)", f", plane{n})") for c in _hash_ctes(hyperplanes(DIM, n))] + [f"near_{n} AS MATERIALIZED (SELECT qid, rank, doc_id FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY n, doc_id) AS rank FROM (SELECT qid, doc_id, sum(CASE WHEN a.bit <> b.bit THEN 1 ELSE 0 END) AS n FROM dbit{n} a JOIN qbit{n} b ON a.j = b.j GROUP BY qid, doc_id)) WHERE rank <= 10)"]

    banded_near = [f"top{b} AS MATERIALIZED ({_cosine_top(f'cand{b}')})" for b in (4, 8, 16, 32)]
    best = f"best AS (SELECT m, run_id, recall_at_k FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY recall_at_k DESC NULLS LAST, run_id) AS r FROM (SELECT DISTINCT {_METHOD} AS m, run_id, recall_at_k FROM benchmark_runs WHERE method IS NOT NULL)) WHERE r = 1)"
    movie_columns = ["doc_id", "title", "plot", "decade", "studio", "tokens", "scraped_at", "loaded_at"]
    nulls = ", ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in movie_columns)
    return {
        "x1_exact_l2": _sql("SELECT * FROM truth", _TRUTH),
        "x2_exact_cosine": _sql("SELECT * FROM near", _ranked(_COS, "near", descending=True)),
        "x3_flat_l2sq": _sql("SELECT * FROM near", _ranked("power(list_distance({v}, {q}), 2)", "near")),
        "x4_similar_items": _sql("SELECT qid, rank, n.doc_id, title, decade, score FROM near n LEFT JOIN (SELECT doc_id, min(title) AS title, min(decade) AS decade FROM doc_metadata GROUP BY 1) m ON n.doc_id = m.doc_id", _ranked(_DOT, "near", 5, True, where="WHERE doc_id <> qid")),
        "x5_dot_top5": _sql("SELECT * FROM near", _ranked(_DOT, "near", 5, True)),
        "k1_cosine_columns": _sql("SELECT qid, CAST(vec_id AS BIGINT) AS doc_id, round(" + _COS.format(q="qv", v="v") + ", 6) AS cosine, round(list_distance(v, qv), 6) AS distance, round(list_inner_product(v, qv), 6) AS dot FROM e, queries", "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)", base=False),
        "rel_dim_prefix_knn": _sql("SELECT * FROM half", _HALF),
        "rel_row_prefix": _sql("SELECT doc_id, round(sqrt(list_inner_product(v[1:16], v[1:16])), 6) AS norm16 FROM docs WHERE doc_id < 500"),
        "e5_norms": "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings",
        "e4_normalize": _sql("SELECT doc_id, round(v[1], 6) AS first, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM docs"),
        "e4b_normalize_epsilon": _sql("SELECT doc_id, round(x[1] / (sqrt(list_inner_product(x, x)) + 1e-10), 6) AS first FROM usable"),
        "s2_cast_vectors": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
        "v1_centroids": _sql("SELECT cid, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT cid, unnest(cv) AS x, generate_subscripts(cv, 1) AS i FROM km_c)", *_IVF),
        "v2_assign": _sql("SELECT doc_id, cid FROM km_a", *_IVF),
        "v3_probe": _sql("SELECT qid, cid, round(d2, 6) AS d2, CAST(probe_rank AS INTEGER) AS probe_rank FROM probe WHERE probe_rank <= 2", *_IVF, _PROBE),
        "v5_search": _sql("SELECT * FROM near", *_IVF, _PROBE, _probed(2)),
        "v6_candidate_ratio": _sql("SELECT qid, CAST(count(a.doc_id) AS BIGINT) AS n_candidates, round(count(a.doc_id) / (SELECT count(*) FROM docs), 6) AS candidate_ratio FROM probe p LEFT JOIN km_a a ON a.cid = p.cid WHERE probe_rank <= 2 GROUP BY qid", *_IVF, _PROBE),
        "b1_sweep": _sql("SELECT 1 AS n_probes, * FROM near1 UNION ALL SELECT 2, * FROM near2 UNION ALL SELECT 5, * FROM near5", *_IVF, _PROBE, sweep),
        "b1_sweep_metrics": _sql("SELECT CAST(n AS INTEGER) AS n_probes, round(avg(h / 10), 6) AS recall_at_k FROM (SELECT n, q.qid, count(t.doc_id) AS h FROM (SELECT DISTINCT qid FROM truth) q, (VALUES (1), (2), (5)) g(n) LEFT JOIN every e ON e.qid = q.qid AND e.n_probes = n LEFT JOIN truth t ON t.qid = e.qid AND t.doc_id = e.doc_id GROUP BY 1, 2) GROUP BY n", *_IVF, _PROBE, sweep, _TRUTH, "every AS (SELECT 1 AS n_probes, * FROM near1 UNION ALL SELECT 2, * FROM near2 UNION ALL SELECT 5, * FROM near5)"),
        "f2_ivfflat": _sql("SELECT *, round(CAST(0.625 AS DOUBLE), 6) AS nominal_ratio FROM near", *_IVF, _PROBE, _probed(5, "power(list_distance({v}, {q}), 2)")),
        "v5_search_200": _sql("SELECT * FROM near", _WHOLE, *_lloyd("whole", "km", 200, ROUNDS), _PROBE, _probed(5)),
        "b1_sweep_200": _sql("SELECT j.n_probes, recall_at_k, ndcg_at_k, candidate_ratio FROM judged j JOIN (SELECT n_probes, round(avg(n / (SELECT count(*) FROM docs)), 6) AS candidate_ratio FROM (SELECT g.n_probes, p.qid, count(a.doc_id) AS n FROM probe p JOIN (VALUES (1), (2), (5), (10), (20)) g(n_probes) ON p.probe_rank <= g.n_probes LEFT JOIN km_a a ON a.cid = p.cid GROUP BY 1, 2) GROUP BY 1) c ON c.n_probes = j.n_probes", *flat(200)),
        "b7_ivf_sweep": _sql("SELECT n_probes, recall_at_k, ndcg_at_k, round(n_probes / CAST(100 AS DOUBLE), 6) AS nominal_ratio FROM judged", *flat(100)),
        "q7_search_256": _sql("SELECT qid, rank, doc_id, score FROM near_4", *quantised(4)),
        "b3_pq_sweep": _sql("SELECT m, recall_at_k, ndcg_at_k, round(CAST(128.0 AS DOUBLE) / m, 6) AS compression_ratio FROM judged", *quantised(2), *quantised(4), *quantised(8), _TRUTH, judge("m", " UNION ALL ".join(f"SELECT CAST({m} AS INTEGER) AS m, qid, rank, doc_id FROM near_{m}" for m in (2, 4, 8)))),
        "b5_lsh_metrics": _sql("SELECT c.b_bands, coalesce(recall_at_k, 0) AS recall_at_k, coalesce(ndcg_at_k, 0) AS ndcg_at_k, candidate_ratio FROM (" + " UNION ALL ".join(f"SELECT CAST({b} AS INTEGER) AS b_bands, round(count(*) / (SELECT count(*) FROM docs) / (SELECT count(*) FROM queries), 6) AS candidate_ratio FROM cand{b}" for b in (4, 8, 16, 32)) + ") c LEFT JOIN judged j ON j.b_bands = c.b_bands", *m128, *(x for b in (4, 8, 16, 32) for x in _banded(b)), *banded_near, _TRUTH, judge("b_bands", " UNION ALL ".join(f"SELECT CAST({b} AS INTEGER) AS b_bands, qid, rank, doc_id FROM top{b}" for b in (4, 8, 16, 32)))),
        "b7_hamming_sweep": _sql("SELECT nbits, recall_at_k, ndcg_at_k FROM judged", *(c for n in (64, 128, 256, 512) for c in bits_near(n)), _TRUTH, judge("nbits", " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS nbits, qid, rank, doc_id FROM near_{n}" for n in (64, 128, 256, 512)))),
        "q2_subvectors": _sql("SELECT doc_id, sub, CAST(len(v) AS INTEGER) AS width, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM part", _PQ[0]),
        "q3_codebook": _sql("SELECT sub, code, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT sub, cid AS code, unnest(cv) AS x, generate_subscripts(cv, 1) AS i FROM pq_c)", *_PQ),
        "q4_encode": _sql("SELECT doc_id, sub, cid AS code FROM pq_a", *_PQ),
        "q5_adc_table": _sql("SELECT qid, sub, cid AS code, round(d2, 6) AS d2 FROM adc", *_PQ, _QPART, _ADC),
        "q7_search": _sql(top.format("SELECT qid, doc_id, round(sum(d2), 6) AS score FROM adc JOIN pq_a a ON a.sub = adc.sub AND a.cid = adc.cid GROUP BY qid, doc_id"), *_PQ, _QPART, _ADC),
        "q8_compression": "SELECT m, CAST(4.0 * 64 / (2 * m) AS DOUBLE) AS compression_ratio FROM (VALUES (2), (4), (8)) t(m)",
        "f3_ivfpq": _sql(top.format(residual_sums), *ivfpq(_IVF, PQ_K, 2)),
        "f3_ivfpq_100": _sql(top.format(residual_sums), *ivfpq([_WHOLE, *_lloyd("whole", "km", 100, ROUNDS)], 256, 5)),
        "h2_signatures": _sql("SELECT doc_id, string_agg(bit, '' ORDER BY j) AS signature FROM dbit GROUP BY doc_id", *m32),
        "h3_bands": _sql("SELECT doc_id, CAST(j // 8 AS INTEGER) AS band, string_agg(bit, '' ORDER BY j) AS key FROM dbit GROUP BY 1, 2", *m32),
        "h4_candidates": _sql("SELECT * FROM cand16", *m128, *_banded(16)),
        "h5_search": _sql(_cosine_top("cand16"), *m128, *_banded(16)),
        "h7_candidate_ratio": _sql("SELECT qid, CAST(count(doc_id) AS BIGINT) AS n_candidates, round(count(doc_id) / (SELECT count(*) FROM docs), 6) AS candidate_ratio FROM queries LEFT JOIN cand16 USING (qid) GROUP BY qid", *m128, *_banded(16)),
        "b5_lsh_sweep": _sql(" UNION ALL ".join(f"SELECT {b} AS b_bands, qid, count(*) AS n_candidates FROM cand{b} GROUP BY qid" for b in (4, 8, 16, 32)), *m128, *(x for b in (4, 8, 16, 32) for x in _banded(b))),
        "g1_table_keys": _sql("SELECT * FROM dk", *tables, keys[0]),
        "g4_table_statistics": _sql("SELECT tbl, count(*) AS buckets, round(avg(n), 6) AS mean_size, max(n) AS max_size FROM (SELECT tbl, key, count(*) AS n FROM dk GROUP BY 1, 2) GROUP BY tbl", *tables, keys[0]),
        "g5_search": _sql(_cosine_top("cand"), *tables, *keys),
        "g7_candidate_count": _sql("SELECT qid, count(DISTINCT doc_id) AS n_candidates FROM cand GROUP BY qid", *tables, *keys),
        "g8_formulas": "SELECT s AS similarity, round(p, 6) AS collision, round(1 - power(1 - p, 10), 6) AS recall FROM (SELECT s, power(1 - acos(s) / pi(), 15) AS p FROM (SELECT (i - 10) / CAST(10 AS DOUBLE) AS s FROM range(21) r(i)))",
        "g10_parameter_grid": "SELECT CAST(k AS INTEGER) AS k, CAST(t AS INTEGER) AS tables, round(1 - power(1 - power(1 - acos(CAST(0.7 AS DOUBLE)) / pi(), k), t), 6) AS recall, CAST(power(2, k) AS BIGINT) AS buckets FROM (VALUES (5), (10), (15), (20), (25)) a(k), (VALUES (1), (5), (10), (15), (20)) b(t)",
        "g11_lsh_vs_brute": _sql(f"SELECT q.qid, round(count(t.doc_id) / 5, 6) AS recall_at_5, round(100 * any_value(coalesce(n, 0)) / (SELECT count(*) FROM docs), 6) AS percent_examined FROM queries q LEFT JOIN ({_cosine_top('cand', 5)}) c ON c.qid = q.qid LEFT JOIN five t ON t.qid = c.qid AND t.doc_id = c.doc_id LEFT JOIN (SELECT qid, count(*) AS n FROM cand GROUP BY 1) z ON z.qid = q.qid GROUP BY q.qid", *tables, *keys, _ranked(_DOT, "five", 5, True)),
        "f4_hamming": _sql(top.format("SELECT qid, doc_id, CAST(sum(CASE WHEN a.bit <> b.bit THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM dbit a JOIN qbit b ON a.j = b.j GROUP BY qid, doc_id"), *h60),
        "m14_evaluate_per_query": _sql("SELECT * EXCLUDE (standard) FROM each", *judged),
        "m4_standard_average_precision": _sql("SELECT qid, standard AS average_precision FROM each", *judged),
        "m15_evaluate_batch": _sql("SELECT round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(f1_at_k), 6) AS f1_at_k, round(avg(ndcg_at_k), 6) AS ndcg_at_k, round(avg(average_precision), 6) AS map, round(avg(reciprocal_rank), 6) AS mrr, count(*) AS n_queries FROM each", *judged),
        "m6_dcg": _sql("SELECT qid, round(coalesce(dcg, 0), 6) AS dcg_at_k FROM q LEFT JOIN inside USING (qid)", *judged),
        "m10_pr_curve": _sql("SELECT qid, k, hits, relevant, round(hits / relevant, 6) AS recall, round(hits / k, 6) AS precision FROM curve", _TRUTH, _HALF, _CURVE),
        "m11_interpolated": _sql("SELECT qid, round(i / CAST(10 AS DOUBLE), 6) AS level, round(coalesce(max(hits / k) FILTER (hits * 10 >= i * relevant), 0), 6) AS precision FROM curve, range(11) r(i) GROUP BY qid, i", _TRUTH, _HALF, _CURVE),
        "m12_ratio_speedup": "SELECT DISTINCT run_id, round(n_candidates / n_docs, 6) AS ratio, CASE WHEN n_candidates = 0 THEN CAST('inf' AS DOUBLE) ELSE round(n_docs / n_candidates, 6) END AS speedup FROM benchmark_runs WHERE n_candidates IS NOT NULL AND n_docs IS NOT NULL",
        "t1_tokens": _sql(f"SELECT doc_id, {_JOINED.format(w='w')} AS tokens FROM word", _WORDS, base=False),
        "t5_stop_words": _sql(f"SELECT doc_id, {_JOINED.format(w=f'list_filter(w, lambda t: t NOT IN ({stop}))')} AS tokens FROM word", _WORDS, base=False),
        "t7_concat_nulls": "SELECT DISTINCT doc_id, coalesce(title, 'nan') || ' ' || coalesce(plot, 'nan') AS text FROM movies",
        "t9_token_counts": _sql(f"{_SUMMARY} (SELECT len(w) AS n FROM word)", _WORDS, base=False),
        "t10_vocabulary": _sql("SELECT count(DISTINCT t) AS vocabulary FROM (SELECT unnest(w) AS t FROM word)", _WORDS, base=False),
        "t11_top_terms": _sql("SELECT t AS term, count(*) AS n FROM (SELECT unnest(w) AS t FROM word) GROUP BY t ORDER BY n DESC, t LIMIT 20", _WORDS, base=False),
        "t12_text_lengths": f"{_SUMMARY} (SELECT length(plot) AS n FROM movies)",
        "l3_tfidf": _sql("SELECT doc_id, term, tf, round(tf * (ln(((SELECT count(*) FROM word) + 1) / (df + 1)) + 1), 6) AS w FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) USING (term)", _WORDS, "tf AS MATERIALIZED (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM word) GROUP BY 1, 2)", base=False),
        "e2_mean_pool": _sql("SELECT doc_id, round(coalesce(a, 0), 6) AS mean_length, round(coalesce(b, 0), 6) AS mean_vowels, CAST(CASE WHEN a IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS one FROM documents LEFT JOIN (SELECT doc_id, avg(length(t)) AS a, avg(length(regexp_replace(t, '[^aeiou]', '', 'g'))) AS b FROM (SELECT doc_id, unnest(w) AS t FROM word) WHERE length(t) > 2 GROUP BY 1) USING (doc_id)", _WORDS, base=False),
        "s1_labelled_parts": "SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n, lower(lang[1:2]) AS decade FROM documents",
        "s1_labelled_csv": "SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n, coalesce(lower(lang[1:2]), 'none') AS decade FROM documents",
        "s3_metadata_rows": "SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns FROM doc_metadata",
        "s5_round_trip": _sql("SELECT d.doc_id, round(CAST(1 AS DOUBLE), 4) AS norm, title, decade FROM docs d LEFT JOIN (SELECT doc_id, min(title) AS title, min(decade) AS decade FROM doc_metadata GROUP BY 1) m ON m.doc_id = d.doc_id"),
        "s7_result_csv": _sql("SELECT m AS method, run_id, 64 AS dim, recall_at_k FROM best", best, base=False),
        "rel_rename": "SELECT DISTINCT doc_id AS id, title AS name, decade AS period FROM doc_metadata",
        "rel_method_filter": f"SELECT DISTINCT run_id, top_k, round(recall_at_k, 6) AS recall_at_k FROM benchmark_runs WHERE {_METHOD} = 'FAISS-IVF'",
        "rel_title_search": " UNION ALL ".join(f"SELECT '{p}' AS pattern, min(doc_id) AS doc_id FROM movies WHERE regexp_matches(title, '(?i){p}') HAVING count(*) > 0" for p in ("ghost", "^the .*harbor", "ledger$")),
        "rel_membership": _sql("SELECT cid, count(*) AS n FROM km_a WHERE cid IN (SELECT cid FROM probe WHERE probe_rank = 1) GROUP BY cid", *_IVF, _PROBE),
        "rel_preview": _sql(f"SELECT doc_id, CASE WHEN length(text) > 150 THEN text[1:150] || '...' ELSE text END AS preview, {_JOINED.format(w='w[1:15]')} AS first_tokens FROM documents JOIN word USING (doc_id)", _WORDS, base=False),
        "rel_unit_conversion": "SELECT DISTINCT run_id, round(candidate_ratio * 1000, 6) AS per_mille FROM benchmark_runs",
        "rel_positions": "SELECT doc_id AS source_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_id FROM documents",
        "a1_group_counts": "SELECT decade, count(*) AS n FROM movies WHERE decade IS NOT NULL GROUP BY decade",
        "a3_all_null_counts": f"SELECT *, {' + '.join(movie_columns)} AS total FROM (SELECT {nulls} FROM movies)",
        "a4_shape": "SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns FROM movies",
        "a5_means": "SELECT method, top_k, round(avg(recall_at_k), 6) AS mean_recall, round(avg(candidate_ratio), 6) AS mean_ratio, count(*) AS n FROM benchmark_runs GROUP BY 1, 2",
        "u1_union": f"SELECT run_id, CAST(n_candidates AS DOUBLE) AS probed, recall_at_k, NULL::DOUBLE AS subvectors FROM benchmark_runs WHERE {_METHOD} = 'VQ' UNION ALL SELECT run_id, NULL, recall_at_k, CAST(dim AS DOUBLE) FROM benchmark_runs WHERE {_METHOD} = 'PQ'",
        "o5_best_per_method": _sql("SELECT * FROM best", best, base=False),
        "j4_lookup": f"SELECT l.m, recall_at_k FROM (VALUES ('VQ'), ('PQ'), ('LSH'), ('FAISS-IVF'), ('FAISS-IVFPQ'), ('FAISS-LSH'), ('HNSW')) l(m) LEFT JOIN (SELECT {_METHOD} AS m, recall_at_k, row_number() OVER (PARTITION BY {_METHOD} ORDER BY run_id, logged_ts) AS r FROM benchmark_runs) b ON b.m = l.m AND r = 1",
        "b9_comparison": _sql("SELECT m, run_id, best.recall_at_k AS best_recall, round(max(n_docs) / max(n_candidates), 6) AS speedup FROM best JOIN benchmark_runs USING (run_id) GROUP BY 1, 2, 3", best, base=False),
        "j1_lookup_join": "SELECT qid AS doc_id, title FROM queries LEFT JOIN (SELECT doc_id, min(title) AS title FROM doc_metadata GROUP BY 1) m ON qid = doc_id",
        "u3_intersection": _sql("SELECT h.qid, CAST(count(t.doc_id) AS INTEGER) AS shared FROM half h LEFT JOIN truth t ON t.qid = h.qid AND t.doc_id = h.doc_id GROUP BY h.qid", _TRUTH, _HALF),
        "z1_sample": f"SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(r AS INTEGER) AS draw, label FROM (VALUES {', '.join(f'({i}, {r})' for r, i in enumerate(sample_ids(500, 50)))}) d(vec_id, r) JOIN embeddings USING (vec_id)",
    }
