"""Queries of the general data-pipeline operators: hierarchies (3) and orphan references (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy as H
from graphloom.operators import orphans as O
from graphloom.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchies(H.hierarchy_links(table(spark, d, "edges")))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchies(H.hierarchy_links(table(spark, d, "edges")), with_paths=True)


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy_links(table(spark, d, "edges")))


def p3_cycles(spark: SparkSession, d: str) -> DataFrame:
    return H.cycles(H.hierarchies(H.hierarchy_links(table(spark, d, "edges"))))


def p3_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Links of ids with several parents that the hierarchies do not follow."""
    return H.dropped_links(H.hierarchy_links(table(spark, d, "edges")))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "external_symbols"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("edge_id", "endpoint").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(_orphans(spark, d))


_LINKS = """
links AS (
  SELECT DISTINCT hierarchy, child, parent FROM (
    SELECT 'containment' AS hierarchy, dst AS child, src AS parent FROM edges
    WHERE type IN ('CONTAINS', 'DEFINES', 'HAS_METHOD', 'HAS_PROPERTY') AND src IS NOT NULL AND dst IS NOT NULL
    UNION ALL
    SELECT 'inheritance', src, dst FROM edges WHERE type = 'EXTENDS' AND src IS NOT NULL AND dst IS NOT NULL)),
ids AS (SELECT hierarchy, child AS id FROM links UNION SELECT hierarchy, parent FROM links),
tops AS (SELECT i.hierarchy, i.id FROM ids i WHERE NOT EXISTS (
  SELECT 1 FROM links l WHERE l.hierarchy = i.hierarchy AND l.child = i.id)),
trees AS (
  SELECT hierarchy, id, id AS root_id, 0 AS depth, [id] AS path FROM tops
  UNION ALL
  SELECT t.hierarchy, l.child, t.root_id, t.depth + 1, list_append(t.path, l.child)
  FROM trees t JOIN links l ON l.hierarchy = t.hierarchy AND l.parent = t.id),
rest AS (SELECT i.hierarchy, i.id FROM ids i WHERE NOT EXISTS (
  SELECT 1 FROM trees t WHERE t.hierarchy = i.hierarchy AND t.id = i.id)),
up AS (
  SELECT r.hierarchy, r.id, l.parent AS cur, [r.id] AS seen FROM rest r JOIN links l ON l.hierarchy = r.hierarchy AND l.child = r.id
  UNION ALL
  SELECT u.hierarchy, u.id, l.parent, list_append(u.seen, u.cur) FROM up u
  JOIN links l ON l.hierarchy = u.hierarchy AND l.child = u.cur WHERE NOT list_contains(u.seen, u.cur)),
closed AS (SELECT hierarchy, id, cur, list_slice(seen, list_position(seen, cur), len(seen)) AS ring FROM up WHERE list_contains(seen, cur)),
loops AS (SELECT hierarchy, id, list_aggregate(ring, 'min') AS root_id, CASE WHEN list_contains(ring, id) THEN -1 ELSE -2 END AS depth FROM closed),
found AS (
  SELECT hierarchy, id AS node_id, root_id, depth FROM trees UNION ALL SELECT hierarchy, id, root_id, depth FROM loops)
"""

_ORPHANS = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY
    (kind IS NOT NULL)::INT + (name IS NOT NULL)::INT + (file_path IS NOT NULL)::INT + (start_line IS NOT NULL)::INT
    + (end_line IS NOT NULL)::INT + (language IS NOT NULL)::INT + (content IS NOT NULL)::INT + (content_hash IS NOT NULL)::INT
    + (signature IS NOT NULL)::INT + (description IS NOT NULL)::INT + (owner IS NOT NULL)::INT + (parameter_count IS NOT NULL)::INT
    + (return_type IS NOT NULL)::INT + (is_exported IS NOT NULL)::INT + (cyclomatic_complexity IS NOT NULL)::INT
    + (repo_uri IS NOT NULL)::INT + (indexed_at IS NOT NULL)::INT + (removed_at IS NOT NULL)::INT DESC,
    (removed_at IS NOT NULL) DESC, removed_at DESC) AS r,
    min(indexed_at) OVER (PARTITION BY id) AS born
  FROM nodes WHERE id IS NOT NULL),
lives AS (SELECT id, born, removed_at AS died FROM ranked WHERE r = 1),
refs AS (
  SELECT DISTINCT id AS edge_id, type, indexed_at AS ref_at, 'src' AS endpoint, src AS key FROM edges WHERE src IS NOT NULL
  UNION SELECT DISTINCT id, type, indexed_at, 'dst', dst FROM edges WHERE dst IS NOT NULL),
orphans AS (
  SELECT r.*, CASE WHEN l.id IS NULL THEN 'missing' WHEN r.ref_at < l.born THEN 'early' WHEN r.ref_at >= l.died THEN 'removed' END AS cause
  FROM refs r LEFT JOIN lives l ON l.id = r.key
  WHERE NOT EXISTS (SELECT 1 FROM external_symbols x WHERE x.id = r.key))
"""

QUERIES = {
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p3_cycles": p3_cycles,
    "p3_dropped": p3_dropped,
    "p5_found": p5_found,
    "p5_report": p5_report,
}

SQL = {
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT hierarchy, node_id, root_id, depth FROM found",
    "p3_paths": f"""WITH RECURSIVE {_LINKS} SELECT f.hierarchy, f.node_id, f.root_id, f.depth, t.path
        FROM found f LEFT JOIN trees t ON t.hierarchy = f.hierarchy AND t.id = f.node_id""",
    # below trees by their paths; on and below cycles by walking down until the walk meets its start or a place it knows
    "p3_descendants": f"""WITH RECURSIVE {_LINKS},
        down AS (
          SELECT f.hierarchy, f.node_id, l.child AS cur, 1 AS distance FROM found f JOIN links l ON l.hierarchy = f.hierarchy AND l.parent = f.node_id
          WHERE f.depth < 0 AND l.child <> f.node_id
          UNION ALL
          SELECT d.hierarchy, d.node_id, l.child, d.distance + 1 FROM down d JOIN links l ON l.hierarchy = d.hierarchy AND l.parent = d.cur
          WHERE l.child <> d.node_id AND l.child <> d.cur)
        SELECT hierarchy, node_id, descendant_id, len(path) - pos AS distance FROM (
        SELECT hierarchy, id AS descendant_id, path, unnest(path) AS node_id, unnest(range(1, len(path) + 1)) AS pos FROM trees)
        WHERE pos < len(path)
        UNION ALL SELECT hierarchy, node_id, cur, min(distance) FROM down GROUP BY 1, 2, 3""",
    "p3_dropped": f"""WITH RECURSIVE {_LINKS} SELECT hierarchy, child, parent FROM links l
        WHERE parent > (SELECT min(m.parent) FROM links m WHERE m.hierarchy = l.hierarchy AND m.child = l.child)""",
    "p3_cycles": f"""WITH RECURSIVE {_LINKS} SELECT hierarchy, root_id, count(*) FILTER (WHERE depth = -1) AS n_on_cycle,
        count(*) FILTER (WHERE depth = -2) AS n_below FROM found WHERE depth < 0 GROUP BY 1, 2""",
    "p5_found": f"WITH {_ORPHANS} SELECT DISTINCT edge_id, endpoint FROM orphans WHERE cause IS NOT NULL",
    "p5_report": f"""WITH {_ORPHANS} SELECT type, endpoint, strftime(ref_at, '%Y-%m') AS month, count(*) AS n_orphans,
        count(*) FILTER (WHERE cause = 'missing') AS n_missing, count(*) FILTER (WHERE cause = 'early') AS n_early,
        count(*) FILTER (WHERE cause = 'removed') AS n_removed FROM orphans WHERE cause IS NOT NULL GROUP BY 1, 2, 3""",
}
