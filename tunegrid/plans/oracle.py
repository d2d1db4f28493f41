"""DuckDB counterparts of the domain views and of the shared recommender steps."""

from __future__ import annotations

AS_OF = "DATE '2001-09-01'"
WEIGHT = f"greatest(0.1, rating / 5) * coalesce(1.0 / log2(greatest(1.0, date_diff('day', rating_date, {AS_OF})::DOUBLE) + 1), 1.0)"

CTES = {
    "inter": """SELECT o_custkey AS id_user, l_partkey AS id_release, (floor(l_quantity / 5) / 2)::DOUBLE AS rating, o_orderdate::DATE AS rating_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        QUALIFY row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1""",
    "pos": "SELECT * FROM inter WHERE rating >= 3.0",
    "parts": """SELECT p_partkey AS id_release, p_name AS title, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS artist_id, p_type AS release_type,
        (p_size + 1950)::BIGINT AS release_year FROM part""",
    "rel": """SELECT parts.*, coalesce(n, 0)::BIGINT AS ratings_count, avg_rating FROM parts
        LEFT JOIN (SELECT id_release, count(*) AS n, avg(rating) AS avg_rating FROM inter WHERE rating > 0 GROUP BY 1) USING (id_release)""",
    "words": "SELECT DISTINCT id_release, unnest(string_split(title, ' ')) AS name FROM parts",
    "gen": "SELECT row_number() OVER (ORDER BY name)::BIGINT AS id_genre, name FROM (SELECT DISTINCT name FROM words)",
    "rg": "SELECT id_release, id_genre FROM words JOIN gen USING (name)",
    "usr": "SELECT c_custkey AS id_user, c_mktsegment AS role, greatest(0.0, least(100.0, c_acctbal / 100)) AS objectivity_score FROM customer",
    "sig": "SELECT id_user, count(*) FILTER (rating >= 3.0) AS n_pos FROM inter GROUP BY 1",
    "base": "SELECT id_release, count(*) AS n FROM pos GROUP BY 1",
    "half": """SELECT a.id_release AS r1, b.id_release AS r2, count(*) AS c FROM pos a JOIN pos b ON a.id_user = b.id_user AND a.id_release < b.id_release
        GROUP BY 1, 2 HAVING count(*) >= 2""",
    "measured": """SELECT r1, r2, c, c::DOUBLE / (x.n + y.n - c) AS j, c::DOUBLE / (x.n * y.n) AS l FROM half
        JOIN base x ON x.id_release = r1 JOIN base y ON y.id_release = r2""",
    "prs": """SELECT r1 AS id_release_1, r2 AS id_release_2, c AS pair_count, j AS jaccard, l AS lift FROM measured
        UNION ALL SELECT r2, r1, c, j, l FROM measured""",
    "ug": f"SELECT id_user, id_genre, sum({WEIGHT} / n) AS weight FROM pos JOIN (SELECT *, count(*) OVER (PARTITION BY id_release) AS n FROM rg) USING (id_release) GROUP BY 1, 2",
    "ua": f"SELECT id_user, artist_id, sum({WEIGHT}) AS weight FROM pos JOIN parts USING (id_release) WHERE artist_id > 0 GROUP BY 1, 2",
    "uv": """SELECT id_user, d, t / sqrt(sum(t * t) OVER (PARTITION BY id_user)) AS v FROM (
        SELECT id_user, d, sum(greatest(0.1, rating / 5) * e) AS t FROM pos JOIN ev USING (id_release)
        WHERE id_user IN (SELECT id_user FROM sig WHERE n_pos >= 20) GROUP BY 1, 2)""",
    "ev": "SELECT vec_id AS id_release, unnest(range(1, 65)) AS d, unnest(embedding)::DOUBLE AS e FROM embeddings",
    "en": "SELECT id_release, d, e / sqrt(sum(e * e) OVER (PARTITION BY id_release)) AS e FROM ev",
    "tv": "SELECT id_release, (d - 1) % 32 AS d, sum(CASE WHEN d <= 32 THEN e ELSE -e END) AS e FROM ev GROUP BY 1, 2",
    "tn": "SELECT id_release, d, e / sqrt(sum(e * e) OVER (PARTITION BY id_release)) AS e FROM tv",
    "tuv": """SELECT id_user, d, t / sqrt(sum(t * t) OVER (PARTITION BY id_user)) AS v FROM (
        SELECT id_user, d, sum(greatest(0.1, rating / 5) * e) AS t FROM pos JOIN tn USING (id_release)
        WHERE id_user IN (SELECT id_user FROM sig WHERE n_pos >= 30) GROUP BY 1, 2)""",
    "tsims": """SELECT id_user, id_release, round(s, 9) AS score FROM (SELECT id_user, id_release, sum(v * e) AS s FROM tuv JOIN tn USING (d) GROUP BY 1, 2)
        ANTI JOIN inter USING (id_user, id_release)""",
    "sims": """SELECT id_user, id_release, round(s, 9) AS score FROM (SELECT id_user, id_release, sum(v * e) AS s FROM uv JOIN en USING (d) GROUP BY 1, 2)
        ANTI JOIN inter USING (id_user, id_release)""",
}


def pair_scores(limit: int) -> str:
    return f"""SELECT id_user, id_release, round(s, 9) AS score, row_number() OVER (PARTITION BY id_user ORDER BY round(s, 9) DESC, id_release) AS rank FROM (
        SELECT id_user, id_release_2 AS id_release, sum({WEIGHT} * pair_count * (0.7 + 0.3 * lift) * (0.5 + 0.5 * jaccard)) AS s FROM (
          SELECT pos.*, prs.* FROM pos JOIN prs ON pos.id_release = id_release_1
          QUALIFY row_number() OVER (PARTITION BY id_user ORDER BY pair_count DESC, id_release_1, id_release_2) <= {10 * limit}) GROUP BY 1, 2)
        QUALIFY rank <= {limit}"""


def rec_pairs(limit: int) -> str:
    return f"""SELECT id_user, id_release, score, row_number() OVER (PARTITION BY id_user ORDER BY score DESC, id_release) AS rank
        FROM (SELECT * EXCLUDE (rank) FROM ({pair_scores(3 * limit)})) ANTI JOIN inter USING (id_user, id_release) QUALIFY rank <= {limit}"""


def pool(limit: int) -> str:
    def side(profile: str, items: str) -> str:
        return f"""SELECT id_user, id_release FROM (SELECT DISTINCT id_user, id_release FROM {profile} JOIN {items})
            QUALIFY row_number() OVER (PARTITION BY id_user ORDER BY id_release) <= {5 * limit}"""

    return f"""SELECT * FROM ({side('ug', 'rg USING (id_genre)')} UNION {side('ua', 'parts USING (artist_id)')}) ANTI JOIN inter USING (id_user, id_release)"""


def rec_content(limit: int) -> str:
    return f"""SELECT id_user, id_release, round(s, 9) AS score, row_number() OVER (PARTITION BY id_user ORDER BY round(s, 9) DESC, id_release) AS rank FROM (
        SELECT id_user, id_release, coalesce(g, 0) + 0.8 * coalesce(ua.weight, 0) + 0.3 * (0.6 * (coalesce(avg_rating, 0) / 5) + 0.3 * ln(1 + ratings_count)
               + 0.1 * greatest(0.0, 1.0 - (2001 - release_year) / 50.0)) AS s
        FROM ({pool(limit)}) JOIN rel USING (id_release) LEFT JOIN ua USING (id_user, artist_id)
        LEFT JOIN (SELECT id_user, id_release, sum(weight) AS g FROM ug JOIN rg USING (id_genre) GROUP BY 1, 2) USING (id_user, id_release))
        QUALIFY rank <= {limit}"""


def rec_vectors(limit: int) -> str:
    return f"SELECT id_user, id_release, score, row_number() OVER (PARTITION BY id_user ORDER BY score DESC, id_release) AS rank FROM sims QUALIFY rank <= {limit}"


def rec_towers(limit: int) -> str:
    return f"SELECT id_user, id_release, score, row_number() OVER (PARTITION BY id_user ORDER BY score DESC, id_release) AS rank FROM tsims QUALIFY rank <= {limit}"


def popular(limit: int, users: str = "SELECT id_user FROM usr") -> str:
    return f"""SELECT id_user, row_number() OVER (PARTITION BY id_user ORDER BY p) AS rank, id_release FROM (SELECT * FROM ({users}), (
        SELECT id_release, row_number() OVER (ORDER BY ratings_count DESC NULLS LAST, avg_rating DESC NULLS LAST, id_release DESC) AS p FROM rel))
        ANTI JOIN inter USING (id_user, id_release) QUALIFY rank <= {limit}"""


def rankings(limit: int) -> str:
    return " UNION ALL ".join(
        f"SELECT id_user, '{name}' AS strategy, rank, id_release FROM ({sql}) SEMI JOIN (FROM sig WHERE n_pos >= {least}) USING (id_user)"
        for name, sql, least in (("pairs", rec_pairs(limit), 1), ("content", rec_content(limit), 1), ("nmf", rec_vectors(limit), 20), ("two_towers", rec_towers(limit), 30))
    )


def linear(sql: str) -> str:
    return f"SELECT *, CASE WHEN count(*) OVER (PARTITION BY id_user) > 1 THEN 1.0::DOUBLE - (rank - 1)::DOUBLE / (count(*) OVER (PARTITION BY id_user) - 1) ELSE 1.0::DOUBLE END AS rank_score FROM ({sql})"


def advanced(limit: int) -> str:
    side = lambda sql: linear(f"SELECT * FROM ({sql}) JOIN (FROM sig WHERE n_pos >= 30) USING (id_user)")
    alone = linear(f"SELECT * FROM ({rec_vectors(limit)}) JOIN (FROM sig WHERE n_pos BETWEEN 20 AND 29) USING (id_user)")
    wa = "CASE WHEN n_pos < 30 THEN 1.0 WHEN n_pos < 51 THEN 0.5 WHEN n_pos < 101 THEN 0.4 WHEN n_pos < 201 THEN 0.3 ELSE 0.2 END"
    wb = "CASE WHEN n_pos < 30 THEN 0.0 WHEN n_pos < 51 THEN 0.5 WHEN n_pos < 101 THEN 0.6 WHEN n_pos < 201 THEN 0.7 ELSE 0.8 END"
    return f"""SELECT id_user, id_release, score, row_number() OVER (PARTITION BY id_user ORDER BY score DESC, id_release) AS rank FROM (
        SELECT id_user, id_release, round(rank_score, 9) AS score FROM ({alone})
        UNION ALL SELECT id_user, id_release, round({wa} * coalesce(x.rank_score, 0) + {wb} * coalesce(y.rank_score, 0) + CASE WHEN x.rank_score IS NULL OR y.rank_score IS NULL THEN 0.0 ELSE 0.2 END, 9)
          FROM (SELECT id_user, id_release, n_pos, rank_score FROM ({side(rec_vectors(3 * limit))})) x FULL JOIN (SELECT id_user, id_release, n_pos, rank_score FROM ({side(rec_towers(3 * limit))})) y USING (id_user, id_release, n_pos)) QUALIFY rank <= {limit}"""


def diversified(sql: str, limit: int, extra: str = "") -> str:
    return f"""SELECT id_user, row_number() OVER (PARTITION BY id_user ORDER BY late, rank) AS place, id_release{extra} FROM (
        SELECT x.*, CASE WHEN artist_id > 0 AND row_number() OVER (PARTITION BY id_user, CASE WHEN artist_id > 0 THEN artist_id END ORDER BY rank) = 1 THEN 0 ELSE 1 END AS late
        FROM ({sql}) x LEFT JOIN parts USING (id_release)) QUALIFY place <= {limit}"""


def fused(limit: int, k: int = 10) -> str:
    return f"""SELECT id_user, id_release, round(sum(1.0::DOUBLE / ({k} + rank)), 9) AS score, row_number() OVER (PARTITION BY id_user ORDER BY round(sum(1.0::DOUBLE / ({k} + rank)), 9) DESC, id_release) AS rank
        FROM rankings GROUP BY id_user, id_release"""


def duck(select: str, **more: str) -> str:
    """select over the domain views that it needs, directly or through others, and the extra ones given."""
    import re

    known = CTES | more
    needed: list[str] = []
    met: set[str] = set()

    def visit(sql: str) -> None:
        for name in known:
            if name not in met and re.search(rf"\b{name}\b", sql):
                met.add(name)
                visit(known[name])
                needed.append(name)

    visit(select)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed) + "\n" if needed else "") + select
