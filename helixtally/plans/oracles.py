"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from helixtally.functions.dna import ENZYMES

REV = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def bases(s: str) -> str:
    return f"coalesce(list_aggregate(list_transform(list_filter(string_split({s}, ' '), lambda w: w <> ''), lambda w: translate(md5(w), '0123456789abcdef', 'ACGTACGTACGTACGT')), 'string_agg', ''), '')"


SEQS = f"""sent AS (SELECT lang AS species, doc_id AS gid, unnest(string_split(text, '. ')) AS s FROM documents),
seqs AS (SELECT row_number() OVER () AS sid, species, gid, {bases("s")} AS seq FROM sent)"""


def _site(motif: str, before: int) -> str:
    parts = f"string_split(seq, '{motif}')"
    return f"SELECT sid, species, gid, seq, unnest(list_transform(range(1, len({parts})), lambda k: len(array_to_string({parts}[1:k], '')) + {len(motif)} * (k - 1) - {before})) AS i FROM seqs"


#: Sites are found by cutting at the motif, which cannot overlap itself.
TAGS = f"""{SEQS},
hits AS ({_site("GGGAC", 6)} UNION {_site("GTCCC", 14)}),
cut AS (SELECT species, gid, substr(seq, i + 1, 25) AS t FROM hits WHERE i >= 0 AND i + 25 <= len(seq)),
tags AS (SELECT species, gid, least(t, {REV.format("t")}) AS marker FROM cut WHERE regexp_full_match(t, '[ACGT]{{25}}')),
gm AS (SELECT species, gid, marker, count(*) AS copies FROM tags GROUP BY ALL),
single AS (SELECT species, gid, marker FROM gm WHERE copies = 1),
genomes AS (SELECT species, gid, count(*) AS n_contigs FROM seqs WHERE seq <> '' GROUP BY ALL),
sample AS (SELECT marker, sum(copies * (length(text) % 7))::BIGINT AS copies FROM gm JOIN documents ON doc_id = gid GROUP BY marker HAVING sum(copies * (length(text) % 7)) > 0)"""

INCIDENCE = "held AS (SELECT DISTINCT l_suppkey % 5 AS species, l_suppkey AS unit, l_partkey AS marker FROM lineitem)"

SIZES = "sizes AS (SELECT g.species, g.gid, count(s.marker) AS n FROM genomes g LEFT JOIN single s USING (species, gid) GROUP BY ALL)"
PAIRS = f"""{SIZES},
shared AS (SELECT x.species, x.gid AS a, y.gid AS b, count(*) AS shared FROM single x JOIN single y ON x.species = y.species AND x.marker = y.marker AND x.gid < y.gid GROUP BY ALL),
pairs AS (SELECT s.species, a, b, shared, x.n AS na, y.n AS nb, shared / (x.n + y.n - shared) AS jaccard, shared / least(x.n, y.n) AS containment
  FROM shared s JOIN sizes x ON x.species = s.species AND x.gid = a JOIN sizes y ON y.species = s.species AND y.gid = b),
empties AS (SELECT x.species, x.gid AS a, y.gid AS b FROM sizes x JOIN sizes y ON x.species = y.species AND x.gid < y.gid AND x.n = 0 AND y.n = 0)"""


def linkage(condition: str, empty: bool = True) -> str:
    return f"""{PAIRS},
edges AS (SELECT species, a, b FROM pairs WHERE {condition} UNION SELECT * FROM empties WHERE {empty}),
both_ways AS (SELECT species, a, b FROM edges UNION SELECT species, b, a FROM edges),
reach AS (SELECT species, gid, gid AS other FROM genomes UNION SELECT r.species, r.gid, e.b FROM reach r JOIN both_ways e ON e.species = r.species AND e.a = r.other),
roots AS (SELECT species, gid, min(other) AS root FROM reach GROUP BY ALL),
mem AS (SELECT species, gid, dense_rank() OVER (PARTITION BY species ORDER BY root) - 1 AS cluster_id FROM roots)"""


CLUSTERS = f"""{TAGS}, {linkage("jaccard >= 0.95")},
units AS (SELECT DISTINCT species, 'C' || cluster_id AS unit, marker FROM single JOIN mem USING (species, gid)),
seen AS (SELECT DISTINCT species, 'C' || cluster_id AS unit, marker FROM gm JOIN mem USING (species, gid)),
alone AS (SELECT species, marker FROM seen GROUP BY ALL HAVING count(*) = 1),
deg AS (SELECT species, marker, count(*) AS degree FROM units GROUP BY ALL),
uniq AS (SELECT species, marker FROM units SEMI JOIN alone USING (species, marker) GROUP BY ALL),
anyu AS (SELECT species FROM uniq GROUP BY ALL),
db AS (SELECT u.species, u.unit, u.marker, d.degree, CASE WHEN a.species IS NOT NULL THEN q.marker IS NOT NULL ELSE d.degree = 1 END AS is_unique
  FROM units u JOIN deg d USING (species, marker) LEFT JOIN uniq q USING (species, marker) LEFT JOIN anyu a USING (species))"""


def stats(db: str) -> str:
    return f"""panel AS (SELECT species, unit, count(*) AS n_markers, sum(is_unique::INT) AS panel_n FROM {db} GROUP BY ALL),
seen_in AS (SELECT species, unit, copies, row_number() OVER (PARTITION BY species, unit ORDER BY copies DESC) AS r, count(*) OVER (PARTITION BY species, unit) AS d FROM {db} JOIN sample USING (marker) WHERE is_unique),
capped AS (SELECT *, max(CASE WHEN r = d // 100 + 1 THEN copies END) OVER (PARTITION BY species, unit) AS cap FROM seen_in),
sums AS (SELECT species, unit, count(*) AS d1, sum((copies >= 2)::INT) AS d2, sum(least(copies, cap)) AS mass FROM capped GROUP BY ALL),
stats AS (SELECT species, unit, n_markers, panel_n::BIGINT AS panel_n, coalesce(d1, 0) AS detected1, coalesce(d2, 0)::BIGINT AS detected2, CASE WHEN panel_n > 0 THEN coalesce(mass, 0) / panel_n ELSE 0.0 END AS depth FROM panel LEFT JOIN sums USING (species, unit)),
supported AS (SELECT *, CASE WHEN depth >= 3 THEN detected2 ELSE detected1 END AS support, detected1 / panel_n AS coverage FROM stats WHERE panel_n > 0 AND CASE WHEN depth >= 3 THEN detected2 ELSE detected1 END >= 10)"""


CALLS = """gated AS (SELECT * FROM supported WHERE coverage >= 0.1 AND (depth <= 0 OR coverage / (1 - exp(-depth)) >= 0.5)),
calls AS (SELECT species, unit, CASE WHEN sum(depth) OVER w > 0 THEN depth / sum(depth) OVER w ELSE 1.0 / count(*) OVER w END AS abundance, coverage, support::DOUBLE AS support, depth, n_markers FROM gated WINDOW w AS (PARTITION BY species))"""

SPECIFIC = """specific AS (SELECT min(species) AS species, marker FROM (SELECT DISTINCT species, marker FROM db) GROUP BY marker HAVING count(*) = 1)"""
GATE = SPECIFIC + """,
totals AS (SELECT species, count(*) AS total_specific FROM specific GROUP BY ALL),
obs AS (SELECT species, sum(copies) AS observed, count(*) AS once, sum((copies >= 2)::INT) AS twice FROM specific JOIN sample USING (marker) GROUP BY ALL),
gate0 AS (SELECT d.species, coalesce(total_specific, 0) AS total_specific, coalesce(observed, 0) / greatest(coalesce(total_specific, 0), 1) AS "lambda", coalesce(once, 0) AS once, coalesce(twice, 0)::BIGINT AS twice
  FROM (SELECT DISTINCT species FROM db) d LEFT JOIN totals USING (species) LEFT JOIN obs USING (species)),
gate1 AS (SELECT *, CASE WHEN "lambda" >= 3 THEN twice ELSE once END AS present_specific, greatest(least(greatest(CASE WHEN "lambda" <= 0 THEN 0 ELSE 1 - exp(-"lambda") END, 0), 1), 0.25) AS r FROM gate0)"""


def gate(markers: int, detect: int) -> str:
    return f"""{GATE},
gates AS (SELECT species, present_specific, total_specific, "lambda", CASE WHEN present_specific >= greatest(ceil({markers} * r), {detect}, 1) THEN 'resolved' WHEN present_specific >= least({detect}, greatest(ceil({markers} * r), {detect}, 1)) THEN 'detected' ELSE 'absent' END AS tier FROM gate1)"""


def community(markers: int = 200, detect: int = 10) -> str:
    return f"""{CLUSTERS}, {gate(markers, detect)},
used AS (SELECT d.species, d.unit, d.marker, d.is_unique AND s.marker IS NOT NULL AS is_unique FROM db d LEFT JOIN specific s USING (species, marker) SEMI JOIN (SELECT species FROM gates WHERE tier = 'resolved') q ON q.species = d.species),
{stats("used")}, {CALLS}"""


_M = "18446744073709551616::UHUGEINT"
SKETCH = f"""{INCIDENCE},
m0 AS (SELECT species, unit AS gid, marker, marker::UBIGINT AS x FROM held),
m1 AS (SELECT species, gid, (xor(x, x >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % {_M})::UBIGINT AS x FROM m0),
m2 AS (SELECT species, gid, (xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % {_M})::UBIGINT AS x FROM m1),
m3 AS (SELECT DISTINCT species, gid, xor(x, x >> 31) AS h FROM m2),
sk AS (SELECT * FROM m3 QUALIFY row_number() OVER (PARTITION BY species, gid ORDER BY h) <= 64),
size AS (SELECT species, unit AS gid, count(*) AS n FROM held GROUP BY ALL),
cand AS (SELECT DISTINCT x.species, x.gid AS a, y.gid AS b FROM sk x JOIN sk y ON x.species = y.species AND x.h = y.h AND x.gid < y.gid),
un AS (SELECT c.species, c.a, c.b, s.h, count(*) AS k FROM cand c JOIN sk s ON s.species = c.species AND s.gid IN (c.a, c.b) GROUP BY ALL),
top AS (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY species, a, b ORDER BY h) <= 64),
est AS (SELECT species, a, b, avg((k = 2)::INT) AS j FROM top GROUP BY ALL)"""


def multi_enzyme() -> str:
    seqs = f"""sent AS (SELECT unnest(string_split(text, '. ')) AS s FROM conversations), seqs AS (SELECT {bases("s")} AS seq FROM sent),
win AS (SELECT seq, unnest(range(0, greatest(0, len(seq) - 24))) AS i FROM seqs)"""
    one = [f"SELECT {e.enzyme_id}::TINYINT AS enzyme_id, substr(seq, i + 1, {e.tag_length}) AS t FROM win WHERE i + {e.tag_length} <= len(seq) AND regexp_full_match(substr(seq, i + 1, {e.tag_length}), '{e.regex}')" for e in ENZYMES]
    return f"WITH {seqs}, tags AS ({' UNION ALL '.join(one)}) SELECT enzyme_id::INT AS enzyme_id, least(t, {REV.format('t')}) AS tag, count(*) AS copies FROM tags GROUP BY ALL"
