"""SQL twins of the operators' queries, where SQL can express them."""

from __future__ import annotations

from driftline.llm.centroids import CLUSTERS, DIMS, SCALE, SEED
from driftline.llm.centroids import ROUNDS as CLUSTER_ROUNDS
from driftline.llm.licenses import CLUE, RULES, SENTENCES, SPEAKS_OF_LICENSE, TAG
from driftline.llm.mixing import BLOCK, ROUNDS, hashed, round_key, swap

ORACLE: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op1_decontaminate"] = rf"""
WITH split AS (
    SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
    UNION ALL
    SELECT 'b', CAST(item_id AS VARCHAR),
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT id AS item, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS content
    FROM (SELECT id, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM split WHERE kind = 'b' AND len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT id, n, i, array_to_string(words[i:i + n - 1], ' ') AS content
    FROM (
        SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM split, sizes WHERE kind = 'd' AND len(words) >= n
    )
), met AS (SELECT d.id, d.n, d.i, b.item FROM doc_windows AS d JOIN item_windows AS b USING (n, content)),
hit_words AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS place FROM met) GROUP BY id),
hit_items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM met) GROUP BY id)
SELECT CAST(s.id AS BIGINT) AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split AS s LEFT JOIN hit_words USING (id) LEFT JOIN hit_items USING (id) WHERE kind = 'd'
"""


def _shuffled(table: str, into: str) -> str:
    """CTEs that send column x of a table with n, rank and epoch through the rounds of the shuffle."""
    steps, last = [], table
    for turn in range(1, ROUNDS + 1):
        key = round_key("n", "rank", "epoch", str(turn)).replace(" div ", " // ")
        moved = swap("x", "k", "n", "rank", "epoch", str(turn), "//")
        steps.append(f"{into}_{turn} AS (SELECT * REPLACE ({moved} AS x) FROM (SELECT *, {key} AS k FROM {last})) ")
        last = f"(SELECT * EXCLUDE (k) FROM {into}_{turn})"
    return ", ".join(steps)


ORACLE["op5_mix_sources"] = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM docs GROUP BY source
), weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
filling AS (
    SELECT 0 AS round, rank, CAST(NULL AS BIGINT) AS held FROM weighed
    UNION ALL
    SELECT round + 1, rank, CASE WHEN held IS NOT NULL THEN held WHEN 2 * source_size * open_weight <= weight * left_over THEN 2 * source_size END
    FROM (
        SELECT f.round, f.rank, f.held, w.source_size, w.weight,
            1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(held) OVER (), 0) AS left_over,
            sum(CASE WHEN held IS NULL THEN weight ELSE 0 END) OVER () AS open_weight
        FROM filling AS f JOIN weighed AS w USING (rank) WHERE round < 40
    )
), held AS (SELECT rank, held FROM filling WHERE round = 40),
aims AS (
    SELECT w.*, CASE WHEN held IS NOT NULL THEN CAST(held AS DOUBLE) ELSE
        weight * (sum(source_size) OVER () * 3.0::DOUBLE / 2 - coalesce(sum(held) OVER (), 0))
            / sum(CASE WHEN held IS NULL THEN weight ELSE 0 END) OVER () END AS target
    FROM weighed AS w JOIN held USING (rank)
), cut AS (
    SELECT *, (source_size + {BLOCK - 1}) // {BLOCK} AS n, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS passes,
        CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest
    FROM aims
), places AS (SELECT rank, n, passes AS epoch, unnest(range(0, n)) AS place, rest, source_size FROM cut WHERE rest > 0),
before AS (SELECT *, place AS x FROM places),
{_shuffled("before", "turned")},
lengths AS (
    SELECT rank, place, x AS number, rest, CASE WHEN x = n - 1 THEN source_size - (n - 1) * {BLOCK} ELSE {BLOCK} END AS words
    FROM turned_{ROUNDS}
), part_taken AS (
    SELECT rank, number, greatest(0, least(words, rest - (sum(words) OVER (PARTITION BY rank ORDER BY place) - words))) AS words FROM lengths
), laid AS (
    SELECT d.doc_id, d.size, c.rank, c.passes, c.source_size, c.target,
        CAST(sum(d.size) OVER (PARTITION BY c.rank ORDER BY {hashed(f"doc_id & {(1 << 63) - 1}", "//")}, doc_id) AS BIGINT) - d.size AS first
    FROM docs AS d JOIN cut AS c ON d.source IS NOT DISTINCT FROM c.source
), pieces AS (
    SELECT doc_id, rank, number, greatest(first - number * {BLOCK}, 0) AS low, least(first + size - number * {BLOCK}, {BLOCK}) AS high
    FROM (SELECT *, unnest(range(first // {BLOCK}, (first + size - 1) // {BLOCK} + 1)) AS number FROM laid WHERE size > 0)
), part_by_doc AS (
    SELECT doc_id, sum(greatest(0, least(high, words) - low)) AS words FROM pieces JOIN part_taken USING (rank, number) GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, CAST(passes * size + coalesce(words, 0) AS BIGINT) AS taken
FROM laid LEFT JOIN part_by_doc USING (doc_id)
"""


def _rules() -> tuple[str, str]:
    """CTEs that let the rules consume a text's sequence of identifiers one after the other; the last one's name."""
    steps, last = [], "sequences"
    for nth, (name, ids) in enumerate(RULES):
        frame = "," + ",".join(ids) + ","
        steps.append(
            f"rule_{nth} AS (SELECT doc_id, replace(rest, '{frame}', ',;,') AS rest, CASE WHEN contains(rest, '{frame}') "
            f"AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})"
        )
        last = f"rule_{nth}"
    return ", ".join(steps), last


_STEPS, _LAST = _rules()
_KNOWN = ", ".join(f"('{text}', '{name}')" for name, text in SENTENCES.items())
ORACLE["op3_license_scan"] = rf"""
WITH known(sentence, name) AS (VALUES {_KNOWN}),
lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
parted AS (
    SELECT doc_id, regexp_replace(regexp_replace(replace(text, '{TAG}', 'spdx license identifier '),
        '([.!?:;])[\x20\x09\x0D\n]+', '\1' || chr(1), 'g'), '\n[^a-z0-9\n\x01]*\n', chr(1), 'g') AS text
    FROM lowered WHERE regexp_matches(text, '{CLUE}')
), runs AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS run, unnest(parts) AS part FROM (SELECT doc_id, string_split(text, chr(1)) AS parts FROM parted)
), lined AS (
    SELECT doc_id, run, list_filter(list_transform(string_split(part, chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS lines
    FROM runs
), parts AS (
    SELECT doc_id, run, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS sentence
    FROM (SELECT doc_id, run, CASE WHEN len(lines) > 1 THEN list_concat([array_to_string(lines, ' ')], lines) ELSE lines END AS p FROM lined)
), named AS (
    SELECT doc_id, run, place, name, name IS NULL AND regexp_matches(sentence, '{SPEAKS_OF_LICENSE}') AS speaks FROM parts LEFT JOIN known USING (sentence)
), by_run AS (
    SELECT doc_id, run, max(name) FILTER (place = 0) AS whole, string_agg(name, ',' ORDER BY place) FILTER (place > 0) AS line_names,
        count(*) FILTER (speaks AND place > 0) AS open_lines, count(*) FILTER (speaks) AS open
    FROM named GROUP BY doc_id, run
), merged AS (
    SELECT doc_id, string_agg(coalesce(whole, line_names), ',' ORDER BY run) AS ids,
        sum(CASE WHEN whole IS NOT NULL THEN 0 WHEN line_names IS NOT NULL THEN open_lines WHEN open > 0 THEN 1 ELSE 0 END) AS n_unknown
    FROM by_run GROUP BY doc_id
), sequences AS (SELECT doc_id, ',' || coalesce(ids, '') || ',' AS rest, CAST([] AS VARCHAR[]) AS found FROM merged),
{_STEPS}
SELECT d.doc_id, coalesce(array_to_string(found, ','), '') AS licenses, coalesce(ids, '') AS sentence_ids,
    CAST(coalesce(n_unknown, 0) AS BIGINT) AS n_unknown
FROM documents AS d LEFT JOIN merged USING (doc_id) LEFT JOIN {_LAST} USING (doc_id)
"""


def _cluster_rounds() -> str:
    """CTEs near_t (assignment to the centroids at_t) and at_t (centroids after t rounds)."""
    steps = []
    for turn in range(CLUSTER_ROUNDS + 1):
        steps.append(f"""near_{turn} AS (
    SELECT r, min(away * {CLUSTERS} + k) % {CLUSTERS} AS k, min(away * {CLUSTERS} + k) // {CLUSTERS} AS away
    FROM (SELECT r, k, sum((e.x - c.x) * (e.x - c.x)) AS away FROM entries AS e JOIN at_{turn} AS c USING (p) GROUP BY r, k) GROUP BY r
)""")
        if turn < CLUSTER_ROUNDS:
            steps.append(f"""at_{turn + 1} AS (
    SELECT k, p, coalesce(m.x, c.x) AS x FROM at_{turn} AS c LEFT JOIN (
        SELECT k, p, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM entries JOIN near_{turn} USING (r) GROUP BY k, p
    ) AS m USING (k, p)
)""")
    return ", ".join(steps)


ORACLE["op11_centroid_clusters"] = f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), entries AS (SELECT r, unnest(range(0, {DIMS})) AS p, unnest(v) AS x FROM kept),
firsts AS (
    SELECT k, v FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS k, v FROM kept) WHERE k < {CLUSTERS}
), at_0 AS (SELECT k, unnest(range(0, {DIMS})) AS p, unnest(v) AS x FROM firsts),
{_cluster_rounds()},
names AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS name FROM at_{CLUSTER_ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(away AS BIGINT) AS distance,
    CAST(sum(away) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(away) OVER () AS BIGINT) AS inertia,
    name AS centroid_sha256
FROM kept JOIN near_{CLUSTER_ROUNDS} USING (r) JOIN names USING (k)
"""
