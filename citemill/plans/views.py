"""Citation-shaped views over the star-schema tables.

The documents hold no bibliographies, so works, reference lists, markers and check
results are derived from ``part`` and ``lineitem`` by SQL that Spark and other
engines read alike.  An order is a manuscript, its distinct parts its references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # catalogue of works
    "works": """
        SELECT CAST(p_partkey AS BIGINT) AS work_id,
               concat(upper(substr(p_name, 1, 1)), lower(substr(split_part(p_name, ' ', 1), 2, 20)), chr(CAST(97 + p_partkey % 26 AS INT))) AS surname,
               CAST(1960 + p_partkey % 60 AS BIGINT) AS year,
               concat('Notes on ', lower(p_type), ' and ', p_name, ' ', CAST(p_partkey AS STRING)) AS title,
               concat('10.', CAST(1000 + p_partkey % 9000 AS STRING), '/w.', CAST(p_partkey AS STRING)) AS doi,
               p_brand AS outlet,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 1500 AS BIGINT) END AS citations,
               CASE WHEN p_partkey % 11 = 0 THEN TRUE WHEN p_partkey % 11 = 1 THEN NULL ELSE FALSE END AS retracted
        FROM part""",
    # reference lists
    "refs": """
        SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_partkey AS BIGINT) AS work_id, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS BIGINT) AS n FROM lineitem""",
    # printed entries; every tenth manuscript has lost its second entry, every third style prints no number
    "entries": """
        SELECT r.doc_id, r.n,
               CASE WHEN r.doc_id % 3 = 2
                    THEN concat(w.surname, ', ', chr(CAST(65 + w.work_id % 26 AS INT)), '. (', CAST(w.year AS STRING), '). ', w.title, '. ', w.outlet, ', ', CAST(1 + w.work_id % 40 AS STRING), '(2), 11-19. https://doi.org/', w.doi)
                    ELSE concat(CASE WHEN r.doc_id % 3 = 0 THEN concat('[', CAST(r.n AS STRING), '] ') ELSE concat(CAST(r.n AS STRING), '. ') END, w.surname, ' ', chr(CAST(65 + w.work_id % 26 AS INT)), '. ', w.title, '. ', w.outlet, '. ', CAST(w.year AS STRING), ';3(2):11-19. doi:', upper(w.doi))
               END AS raw_text, w.surname, w.year
        FROM refs r JOIN works w ON r.work_id = w.work_id
        WHERE NOT (r.doc_id % 10 = 0 AND r.n = 2)""",
    # in-text markers: each cites a reference by number, every 17th one that the list can't have
    "markers": """
        SELECT m.doc_id, CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY m.l_linenumber, m.work_id, m.l_suppkey, m.l_extendedprice, m.l_quantity, m.l_shipdate) AS BIGINT) AS seq,
               CAST(dense_rank() OVER (PARTITION BY m.doc_id ORDER BY m.work_id) + CASE WHEN (m.doc_id + m.work_id) % 17 = 0 THEN 50 ELSE 0 END AS BIGINT) AS number
        FROM (SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_partkey AS BIGINT) AS work_id, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate FROM lineitem) m""",
    # author-date markers, some misspelt, some of another year, some without one
    "author_markers": """
        SELECT m.doc_id, m.seq, CASE WHEN m.seq % 9 = 4 THEN concat(w.surname, 'x') ELSE w.surname END AS surname,
               CASE WHEN m.seq % 7 = 3 THEN NULL WHEN m.seq % 5 = 2 THEN CAST(w.year + 1 AS STRING) ELSE CAST(w.year AS STRING) END AS year
        FROM markers m JOIN refs r ON m.doc_id = r.doc_id AND m.number = r.n JOIN works w ON r.work_id = w.work_id""",
    # one sentence a work, with a marker in each form that a manuscript may have, or something like one
    "forms": """
        SELECT work_id, work_id % 14 AS form, surname, CAST(year AS STRING) AS y,
               CASE work_id % 14
                    WHEN 0 THEN concat('As ', surname, ' (', CAST(year AS STRING), ') holds.')
                    WHEN 1 THEN concat('Here ', surname, ' and Moe (', CAST(year AS STRING), ', p. 15) differ.')
                    WHEN 2 THEN concat('So it is (see ', surname, ', ', CAST(year AS STRING), '; Moe, n.d.).')
                    WHEN 3 THEN 'It is known [12, p. 5] now.'
                    WHEN 4 THEN 'As in Table [3] above.'
                    WHEN 5 THEN 'It was 95% CI [2, 5] here.'
                    WHEN 6 THEN concat('A note ends.', chr(10), '[3] ', surname, ' argues so.')
                    WHEN 7 THEN concat('Die zweite Welle (', CAST(year AS STRING), ') kam.')
                    WHEN 8 THEN concat('The war of ', surname, ' (1939-1945) ended.')
                    WHEN 9 THEN 'All agree [1, 3-5].'
                    WHEN 10 THEN concat('It began (Oktober ', CAST(year AS STRING), ') there.')
                    WHEN 11 THEN concat('However, ', surname, ' (', CAST(year AS STRING), ') is.')
                    WHEN 12 THEN concat('of van der ', surname, ' et al. (', CAST(year AS STRING), 'b) we')
                    ELSE concat('f[7] and x = 3 (4)', chr(10), 'hold.') END AS text,
               CASE work_id % 6
                    WHEN 0 THEN '[12, p. 5]' WHEN 1 THEN concat(surname, ' (', CAST(year AS STRING), ')') WHEN 2 THEN concat('(see ', surname, ', ', CAST(year AS STRING), ')')
                    WHEN 3 THEN concat('May (', CAST(year AS STRING), ')') WHEN 4 THEN '[9-3]' ELSE ' 3 ' END AS marker
        FROM works""",
    # one entry a work, in five styles, the last without a title that a rule could tell
    "styled": """
        SELECT w.work_id, w.surname, CAST(w.year AS STRING) AS y, lower(p.p_type) AS kind, w.work_id % 5 AS style,
               CASE w.work_id % 5
                    WHEN 0 THEN concat(w.surname, ', A., & Moe, B. (', CAST(w.year AS STRING), 'a). Notes on ', lower(p.p_type), '. Shore Letters, 3(2), 11-19.')
                    WHEN 1 THEN concat(w.surname, ' A, Moe BC. Notes on ', lower(p.p_type), '. Shore Letters. ', CAST(w.year AS STRING), ';3:1-2.')
                    WHEN 2 THEN concat('[7] A. ', w.surname, ' and B. Moe, "Notes on ', lower(p.p_type), '," Shore Letters, vol. 3, ', CAST(w.year AS STRING), '.')
                    WHEN 3 THEN concat(w.surname, ', A., ', CAST(w.year AS STRING), '. Notes on ', lower(p.p_type), '. Shore Letters 3.')
                    ELSE concat(w.surname, ', A: Notes on ', lower(p.p_type), ', Shore Letters 12, ', CAST(w.year AS STRING), '-', CAST(w.year + 3 AS STRING), '.') END AS raw_text
        FROM part p JOIN works w ON w.work_id = p.p_partkey""",
    # outcome of the look-up of each reference, before duplicates are found
    "checked": """
        SELECT r.doc_id, r.n, w.title AS raw, w.surname,
               CASE WHEN (r.doc_id + r.n) % 10 = 0 THEN 'review' WHEN (r.doc_id + r.n) % 10 = 1 THEN 'halluc' WHEN (r.doc_id + r.n) % 10 = 2 THEN 'unchecked' ELSE 'verified' END AS status,
               CASE WHEN (r.doc_id + r.n) % 10 IN (1, 2) THEN NULL WHEN r.n > 1 AND (r.doc_id * 3 + r.n) % 4 = 0 THEN upper(f.doi) ELSE w.doi END AS doi,
               CASE WHEN (r.doc_id + r.n) % 10 = 0 THEN CAST(30 + w.work_id % 55 AS DOUBLE) / 100 WHEN (r.doc_id + r.n) % 10 = 1 THEN CAST(w.work_id % 30 AS DOUBLE) / 100 WHEN (r.doc_id + r.n) % 10 = 2 THEN 0 ELSE CAST(85 + w.work_id % 16 AS DOUBLE) / 100 END AS confidence,
               w.year, w.outlet, w.citations, w.retracted, concat('T', CAST(w.work_id % 23 AS STRING), ',T', CAST(w.work_id % 19 AS STRING)) AS topics
        FROM refs r JOIN works w ON r.work_id = w.work_id
        JOIN (SELECT refs.doc_id, works.doi FROM refs JOIN works ON refs.work_id = works.work_id WHERE refs.n = 1) f ON f.doc_id = r.doc_id""",
}
NEEDS = {"works": [], "refs": [], "entries": ["refs", "works"], "markers": [], "author_markers": ["markers", "refs", "works"], "forms": ["works"], "styled": ["works"], "checked": ["refs", "works"]}


def closed(names) -> list[str]:
    out: list[str] = []
    for n in (x for x in names if x not in TABLES):
        for x in [*closed(NEEDS[n]), n]:
            if x not in out:
                out.append(x)
    return out


def with_views(names, sql: str) -> str:
    held = closed(names)
    if not held:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in held)
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


class Tables:
    """Tables and views by name, as DataFrames of one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        needed = closed([name])
        args = {t: self(t) for t in TABLES if any(f" {t}" in VIEWS[v] for v in needed)}
        sql = with_views(NEEDS[name], VIEWS[name])
        for t in args:
            sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})")
            sql = sql[: -len(t)] + f"{{{t}}}" if sql.endswith(f"FROM {t}") else sql
        return self.spark.sql(sql, **args)
