"""The same queries as SQL for another engine, to hold results against."""

from __future__ import annotations

#: The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
TOP = 1 << 64


def _mul(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT * {b}::UHUGEINT) % {TOP}::UHUGEINT)"


def _add(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT + {b}::UHUGEINT) % {TOP}::UHUGEINT)"


def _steps(name: str, source: str, key: str, start: str, steps: list) -> str:
    """CTEs name0, name1, ...: column h goes through steps, each a function of the text of h."""
    out = [f"{name}0 AS (SELECT {key}, ({start})::UHUGEINT AS h FROM {source})"]
    for i, f in enumerate(steps):
        out.append(f"{name}{i + 1} AS (SELECT {key}, {f('h')} AS h FROM {name}{i})")
    out.append(f"{name} AS (SELECT {key}, h FROM {name}{len(steps)})")
    return ", ".join(out)


def _rot(r: int):
    return lambda h: f"(((({h}) * {1 << r}::UHUGEINT) % {TOP}::UHUGEINT) + (({h}) // {1 << (64 - r)}::UHUGEINT))"


def _shift_xor(r: int):
    return lambda h: f"xor({h}, ({h}) // {1 << r}::UHUGEINT)"


_FINISH = [_shift_xor(33), lambda h: _mul(h, P2), _shift_xor(29), lambda h: _mul(h, P3), _shift_xor(32)]


def xxh64_8(name: str, source: str, key: str, x: str) -> str:
    """XXH64, seed 0, of one 64-bit word."""
    steps = [lambda h: _mul(h, P2), _rot(31), lambda h: _mul(h, P1), lambda h: f"xor({h}, {(P5 + 8) % TOP}::UHUGEINT)", _rot(27), lambda h: _mul(h, P1), lambda h: _add(h, P4)]
    return _steps(name, source, key, x, steps + _FINISH)


def xxh64_4(name: str, source: str, key: str, x: str) -> str:
    """XXH64, seed 0, of one 32-bit word."""
    steps = [lambda h: _mul(h, P1), lambda h: f"xor({h}, {(P5 + 4) % TOP}::UHUGEINT)", _rot(23), lambda h: _mul(h, P2), lambda h: _add(h, P3)]
    return _steps(name, source, key, x, steps + _FINISH)


def build(samples: list[str], k: int, m: int, parts: int, hard: int, window: int, soft: list[int], key: str) -> dict[str, str]:
    n = len(samples)
    reads = "reads AS (SELECT doc_id AS read_id, lang AS sample, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
    strands = "strands AS (SELECT read_id, sample, translate(seq, 'ACTG', '0123') AS f, translate(reverse(seq), 'ACTG', '2301') AS r, len(seq) AS n FROM reads)"
    kmers = f"kmers AS (SELECT read_id, sample, i, least(substr(f, i + 1, {k}), substr(r, n - i - {k} + 1, {k})) AS d FROM (SELECT *, unnest(range(n - {k - 1})) AS i FROM strands WHERE n >= {k}))"
    counts = "counts AS (SELECT sample, d, count(*) AS cnt FROM kmers GROUP BY sample, d)"
    base = f"{reads}, {strands}, {kmers}, {counts}"
    show = "translate(d, '0123', 'ACTG')"
    number = lambda d: f"list_reduce(list_transform(string_split({d}, ''), lambda x: x::UBIGINT), lambda a, b: a * 4 + b)"
    mm = f"list_transform(range({k - m + 1}), lambda j: least(substr(d, j + 1, {m}), substr(rd, {k - m} - j + 1, {m})))"
    distinct = "dk AS (SELECT DISTINCT d, translate(reverse(d), '0123', '2301') AS rd FROM counts)"
    minim = f"minim AS (SELECT d, {number('md')}::BIGINT AS minimizer FROM (SELECT d, list_min(list_transform({mm}, lambda x: CASE WHEN instr(substr(x, 2), '00') = 0 THEN x ELSE '{'3' * m}' END)) AS md FROM dk))"
    part = xxh64_4("hp", "(SELECT DISTINCT minimizer FROM minim)", "minimizer", "minimizer") + f", parts AS (SELECT d, (h % {parts})::BIGINT AS part FROM minim JOIN hp USING (minimizer))"
    placed = f"{base}, {distinct}, {minim}, {part}"
    slot_of = xxh64_8("hk", f"(SELECT d, {number('d')} AS x FROM dk)", "d", "x") + f", slot_of AS (SELECT d, (h % {window})::BIGINT + part * {window} AS slot FROM hk JOIN parts USING (d))"
    all_slots = f"all_slots AS (SELECT sample, slot, sum(cnt)::BIGINT AS cnt FROM counts JOIN slot_of USING (d) GROUP BY sample, slot)"
    slots = f"{placed}, {slot_of}, {all_slots}, slots AS (SELECT * FROM all_slots WHERE cnt >= {hard})"
    cells = lambda of, names=samples: ", ".join(f"coalesce(sum(cnt) FILTER (sample = '{s}'), 0)::BIGINT AS c_{s}" for s in names)
    names = [f"c_{s}" for s in samples]
    cols = ", ".join(names)

    def matrix(least: int, of=samples, name: str = "matrix") -> str:
        listed = ", ".join(f"'{s}'" for s in of)
        return f"{name} AS (SELECT d, {cells('counts', of)} FROM counts WHERE cnt >= {least} AND sample IN ({listed}) GROUP BY d)"

    slot_matrix = f"{slots}, smatrix AS (SELECT slot, {cells('slots')} FROM slots GROUP BY slot)"

    def solid(soft_min: list[int], share: int = 0, rec: int = 1, source: str = "matrix", key_: str = f"{show} AS kmer") -> str:
        count = " + ".join(f"({c} > 0 AND {c} >= {t})::INT" for c, t in zip(names, soft_min, strict=True))
        new = ", ".join(f"CASE WHEN {c} >= {t}{f' OR solid >= {share}' if share else ''} THEN {c} ELSE 0 END AS {c}" for c, t in zip(names, soft_min, strict=True))
        return f"SELECT {key_}, {new} FROM (SELECT *, {count} AS solid FROM {source}) WHERE solid >= {rec}"

    bit = lambda c: f"({c} > 0)::BIGINT AS {c}"
    bits = ", ".join(map(bit, names))
    others = [s for s in samples if s != key]
    other_cols = ", ".join(f"c_{s}" for s in others)
    keyed = f"keyed AS (SELECT d, cnt FROM counts WHERE sample = '{key}' AND cnt >= {hard})"
    hist = "SELECT sample, cnt AS abundance, count(*) AS n_unique, sum(cnt)::BIGINT AS n_total FROM counts WHERE cnt BETWEEN 1 AND 255 GROUP BY sample, cnt"
    cum = "cum AS (SELECT sample, cnt, sum(count(*)) OVER (PARTITION BY sample ORDER BY cnt) AS upto, sum(count(*)) OVER (PARTITION BY sample) AS total FROM counts GROUP BY sample, cnt)"
    limits = f"limits AS (SELECT s.sample, coalesce((SELECT min(cnt) FROM cum WHERE cum.sample = s.sample AND cnt <= 255 AND upto > floor(total * 0.9)), 255) AS t FROM (SELECT DISTINCT sample FROM counts) s)"
    limit = lambda s: f"(SELECT t FROM limits WHERE sample = '{s}')"
    stats = " UNION ALL ".join(
        f"SELECT '{s}' AS sample, count(*) FILTER (c_{s} > 0 AND c_{s} < 3) AS non_solid, count(*) FILTER (c_{s} > 0 AND c_{s} < 3 AND solid >= 1) AS rescued, count(*) FILTER (c_{s} >= 3) AS unique_wo_rescue, count(*) FILTER (c_{s} >= 3 OR (c_{s} > 0 AND solid >= 1)) AS unique_w_rescue, "
        f"coalesce(sum(c_{s}) FILTER (c_{s} >= 3), 0)::BIGINT AS total_wo_rescue, coalesce(sum(c_{s}) FILTER (c_{s} >= 3 OR (c_{s} > 0 AND solid >= 1)), 0)::BIGINT AS total_w_rescue FROM solids"
        for s in samples
    )
    bucket = lambda c, w: f"CASE WHEN {c} = 0 THEN 0 ELSE least(len(bin({c}))::BIGINT, {(1 << w) - 1}) END"
    long_bits = " UNION ALL ".join(f"SELECT slot, '{s}' AS sample FROM smatrix WHERE c_{s} > 0" for s in samples)
    words_ = window // 64
    line = lambda cs: " || ' ' || ".join([show, *cs])
    all_at = lambda t, cs=names: " AND ".join(f"{c} >= {t}" for c in cs)
    dense = f"SELECT s.slot, {{0}} FROM (SELECT unnest(range({window * parts})) AS slot) s LEFT JOIN smatrix USING (slot)"

    return {
        "count_matrix": f"WITH {base}, {matrix(hard)} SELECT {show} AS kmer, {cols} FROM matrix",
        "kmer_explode": f"WITH {base} SELECT read_id, i AS position, {show} AS kmer FROM kmers",
        "kmer_with_n": (
            "WITH runs AS (SELECT lang AS sample, unnest(string_split_regex(regexp_replace(upper(text), '[^ACGT.\\n]', '', 'g'), '[^ACGT]+')) AS seq FROM documents), "
            f"strands AS (SELECT sample, translate(seq, 'ACTG', '0123') AS f, translate(reverse(seq), 'ACTG', '2301') AS r, len(seq) AS n FROM runs WHERE len(seq) >= {k}), "
            f"kmers AS (SELECT sample, least(substr(f, i + 1, {k}), substr(r, n - i - {k} + 1, {k})) AS d FROM (SELECT *, unnest(range(n - {k - 1})) AS i FROM strands)) "
            f"SELECT sample, {show} AS kmer, count(*) AS cnt FROM kmers GROUP BY sample, d"
        ),
        "kmer_count": f"WITH {base} SELECT sample, {show} AS kmer, cnt FROM counts",
        "count_hard_min": f"WITH {base} SELECT sample, {show} AS kmer, cnt FROM counts WHERE cnt >= CASE sample WHEN 'de' THEN 3 WHEN 'en' THEN 5 ELSE {hard} END",
        "count_saturated": f"WITH {base} SELECT sample, {show} AS kmer, least(cnt, 255) AS cnt FROM counts",
        "kmer_hist": f"WITH {base} {hist}",
        "kmer_hist_oob": f"WITH {base} SELECT sample, count(*) AS n_unique, sum(cnt)::BIGINT AS n_total, count(*) FILTER (cnt < 1) AS below_unique, coalesce(sum(cnt) FILTER (cnt < 1), 0)::BIGINT AS below_total, count(*) FILTER (cnt > 255) AS above_unique, coalesce(sum(cnt) FILTER (cnt > 255), 0)::BIGINT AS above_total FROM counts GROUP BY sample",
        "kmer_code": f"WITH {base}, {distinct} SELECT {show} AS kmer, {number('d')}::BIGINT AS code, {show} AS decoded FROM dk",
        "revcomp": f"WITH {reads} SELECT read_id, translate(reverse(seq), 'ACGT', 'TGCA') AS revcomp FROM reads",
        "canonical": f"WITH {reads}, {strands} SELECT read_id, translate(least(f, r), '0123', 'ACTG') AS canonical FROM strands",
        "mmers": f"WITH {base}, {distinct} SELECT translate(x, '0123', 'ACTG') AS mmer, count(*) AS n FROM (SELECT unnest({mm}) AS x FROM dk) GROUP BY x",
        "minimizer": f"WITH {base}, {distinct}, {minim} SELECT {show} AS kmer, minimizer FROM minim",
        "superkmers": (
            f"WITH {base}, {distinct}, {minim}, marked AS (SELECT read_id, i, minimizer, CASE WHEN minimizer = lag(minimizer) OVER (PARTITION BY read_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM kmers JOIN minim USING (d)), "
            "blocks AS (SELECT read_id, i, minimizer, sum(new) OVER (PARTITION BY read_id ORDER BY i) AS block FROM marked), "
            "cut AS (SELECT *, (i - min(i) OVER (PARTITION BY read_id, block)) // 255 AS part FROM blocks) "
            "SELECT read_id, min(i) AS start, count(*) AS n_kmers, any_value(minimizer) AS minimizer FROM cut GROUP BY read_id, block, part"
        ),
        "static_repart": f"WITH {xxh64_4('hp', f'(SELECT unnest(range({4**m})) AS minimizer)', 'minimizer', 'minimizer')} SELECT minimizer, (h % {parts})::BIGINT AS part FROM hp",
        "partition_sizes": f"WITH {placed} SELECT part, count(*) AS n_kmers FROM counts JOIN parts USING (d) WHERE cnt >= {hard} GROUP BY part",
        "restrict_list": f"WITH {placed} SELECT sample, {show} AS kmer, cnt FROM counts JOIN parts USING (d) WHERE cnt >= {hard} AND part IN (1, 3)",
        "merge_soft_int": f"WITH {base}, {matrix(1)} {solid([3] * n)}",
        "merge_soft_vec": f"WITH {base}, {matrix(1)} {solid(soft)}",
        "merge_soft_float": f"WITH {base}, {matrix(1)}, {cum}, {limits} {solid([limit(s) for s in samples])}",
        "merge_recurrence": f"WITH {base}, {matrix(1)} {solid([2] * n, rec=2)}",
        "merge_rescue": f"WITH {base}, {matrix(1)} {solid([3] * n, share=1)}",
        "merge_stats": f"WITH {base}, {matrix(1)}, solids AS (SELECT *, {' + '.join(f'({c} >= 3)::INT' for c in names)} AS solid FROM matrix) {stats}",
        "pa_matrix": f"WITH {base}, {matrix(hard)} SELECT {show} AS kmer, {bits} FROM matrix",
        "matrix_text": f"WITH {base}, {matrix(hard)} SELECT {line(names)} AS line FROM matrix",
        "pa_text": f"WITH {base}, {matrix(hard)} SELECT {line([f'({c} > 0)::BIGINT' for c in names])} AS line FROM matrix",
        "plugin_threshold": f"WITH {base}, {matrix(1)} SELECT {show} AS kmer, {cols} FROM matrix WHERE {all_at(1)}",
        "plugin_prefix": f"WITH {base}, {matrix(hard)} SELECT {show} AS kmer, {cols} FROM matrix WHERE NOT starts_with(d, '0') OR ({all_at(2)})",
        "aggregate_counts": f"WITH {base} SELECT sample, {show} AS kmer, cnt FROM counts WHERE cnt >= {hard}",
        "aggregate_keys": f"WITH {base}, {matrix(hard)} SELECT {show} AS kmer FROM matrix",
        "aggregate_sorted": f"WITH {base}, {matrix(hard)} SELECT {show} AS kmer, {cols} FROM matrix ORDER BY d",
        "filter_m": f"WITH {base}, {matrix(hard, others)}, {keyed} SELECT {show} AS kmer, {other_cols}, cnt AS c_{key} FROM matrix JOIN keyed USING (d)",
        "filter_m_pa": f"WITH {base}, {matrix(hard, others)}, {keyed} SELECT {show} AS kmer, {', '.join(bit(f'c_{s}') for s in others)} FROM matrix WHERE d IN (SELECT d FROM keyed)",
        "filter_v": f"WITH {base}, {matrix(hard, others)}, {keyed} SELECT {show} AS kmer, coalesce(cnt, 0) AS value FROM matrix LEFT JOIN keyed USING (d)",
        "filter_k": f"WITH {base}, {matrix(hard, others)}, {keyed} SELECT {show} AS kmer, cnt FROM keyed WHERE d NOT IN (SELECT d FROM matrix)",
        "combine_count": f"WITH {base}, {matrix(hard)} SELECT {show} AS kmer, {cols} FROM matrix",
        "combine_pa": f"WITH {base}, {matrix(hard)} SELECT {show} AS kmer, {bits} FROM matrix",
        "combine_counts_run": f"WITH {base}, {matrix(hard)} SELECT {show} AS kmer, {cols} FROM matrix",
        "combine_hash": f"WITH {slot_matrix} SELECT slot, {cols} FROM smatrix",
        "hash_window": f"SELECT p AS part, {window}::BIGINT AS size, p * {window} AS lower, (p + 1) * {window} - 1 AS upper FROM (SELECT unnest(range({parts})) AS p)",
        "hash_count": f"WITH {slots} SELECT sample, slot, cnt FROM slots",
        "hash_vector": f"WITH {slots} SELECT sample, slot FROM slots",
        "hash_count_matrix": f"WITH {slot_matrix} {solid([3] * n, share=2, source='smatrix', key_='slot')}",
        "hash_pa_matrix": f"WITH {slot_matrix} SELECT slot, {bits} FROM smatrix",
        "bloom_matrix": f"WITH {slot_matrix} " + dense.format(", ".join(f"coalesce({c} > 0, FALSE)::BIGINT AS {c}" for c in names)),
        "cbf_matrix": f"WITH {slot_matrix} " + dense.format(", ".join(f"({bucket(f'coalesce({c}, 0)', 2)})::BIGINT AS {c}" for c in names)),
        "cbf_bucket": f"WITH {base} SELECT DISTINCT cnt, " + ", ".join(f"({bucket('cnt', w)})::BIGINT AS b{w}" for w in (1, 2, 3, 8)) + " FROM counts",
        "bf_per_sample": (
            f"WITH {slot_matrix}, set_ AS ({long_bits}), parts_ AS (SELECT DISTINCT sample, slot // {window} AS part FROM set_), "
            f"words AS (SELECT sample, slot // 64 AS w, bit_or(CASE WHEN slot % 64 = 63 THEN (-9223372036854775807 - 1)::BIGINT ELSE (1::BIGINT << (slot % 64)::INT) END) AS word FROM set_ GROUP BY sample, slot // 64) "
            f"SELECT g.sample, g.part, g.w, coalesce(word, 0)::BIGINT AS word FROM (SELECT sample, part, unnest(range({words_})) AS w FROM parts_) g LEFT JOIN words ON words.sample = g.sample AND words.w = g.part * {words_} + g.w"
        ),
        "bloom_fpr": f"WITH {slot_matrix}, set_ AS ({long_bits}) SELECT slot // {window} AS part, sample, round(1 - exp(-count(*)::DOUBLE / {window}), 6) AS fpr FROM set_ GROUP BY slot // {window}, sample",
        "bloom_estimate": f"WITH {slot_matrix}, set_ AS ({long_bits}) SELECT sample, count(*) AS set_slots, round(-{window * parts}::DOUBLE * ln(1 - count(*)::DOUBLE / {window * parts}), 3) AS estimate FROM set_ GROUP BY sample",
        "bam_like_filter": "SELECT l_orderkey, l_linenumber, ref, flag FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS ref, (l_linenumber * 4 + CAST(floor(l_quantity) AS INT) % 4)::INT AS flag FROM lineitem) WHERE (flag & 1) = 1 AND (flag & 8) = 0 AND ref NOT IN ('R')",
    }
