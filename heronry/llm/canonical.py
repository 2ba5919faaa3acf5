"""Problem 5: map freely typed values to a canonical list, by a partition-based pigeonhole join in SQL.

A reference string of length L that may differ in k edits is cut into k + 1 segments; a value within k edits has at least
one of them unchanged near its place. So reference segments and the value's substrings at the possible positions meet in an
equality join, and the built-in levenshtein verifies. Values are made distinct first; unmatched ones come from an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronry.session import cut, table

#: Accented letters and what they stand for when names are compared.
_ACCENTED = "àáâãäåāăąçćčďèéêëēėęěğìíîïīįłñńňòóôõöøōőřśšşťùúûüūůűýÿźžż"
_PLAIN = "aaaaaaaaacccdeeeeeeeegiiiiiilnnnoooooooorssstuuuuuuuyyzzz"
#: Words around a place that say nothing about which place it is.
BEFORE = "anywhere in|remote in|based in|hybrid in|remote|hybrid|near|in|city of"
AFTER = "area|metro area|region|hq|headquarters|head office|office|campus"


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(lower({c}), '{_ACCENTED}', '{_PLAIN}'), '\\pM', ''), '[\\s\\u00a0\\u200b]+', ' '))"


#: Edits allowed for names from a length on; shorter ones, codes mostly, must be exact.
ALLOWED = ((9, 3), (6, 2), (4, 1))


def edits(length: str) -> str:
    """Edits allowed for a name of this length."""
    return f"CASE {' '.join(f'WHEN {length} >= {n} THEN {k}' for n, k in ALLOWED)} ELSE 0 END"


def pigeonhole(spark: SparkSession, values: DataFrame, names: DataFrame) -> DataFrame:
    """(value, name, dist): all pairs of a value and a name within the edits that the name's length allows.

    `values` has `value`, `names` has `name`; nulls match nothing and repeated ones count once. Equal strings are pairs of distance 0.
    Names of under four characters match only as they are. The join's keys are short substrings; both sides may be large.
    """
    return spark.sql(
        f"""
        WITH n AS (SELECT name, length(name) AS len, {edits("length(name)")} AS k FROM (SELECT DISTINCT name FROM {{names}} WHERE name IS NOT NULL)),
        v AS (SELECT value, length(value) AS l FROM (SELECT DISTINCT value FROM {{values}} WHERE value IS NOT NULL)),
        piece AS (SELECT name, len, k, i, substring(name, CAST(floor(i * len / (k + 1)) AS INT) + 1, CAST(floor((i + 1) * len / (k + 1)) - floor(i * len / (k + 1)) AS INT)) AS part
          FROM (SELECT *, explode(sequence(0, k)) AS i FROM n WHERE k > 0)),
        -- for each length and piece, the places where the piece can stand if the edits left of it and right of it are at most k in all
        place AS (SELECT value, l, len, k, i, CAST(floor(i * len / (k + 1)) AS INT) AS s, CAST(floor((i + 1) * len / (k + 1)) - floor(i * len / (k + 1)) AS INT) AS w
          FROM (SELECT *, explode(sequence(0, k)) AS i FROM (SELECT *, {edits("len")} AS k FROM (SELECT *, explode(sequence(greatest({ALLOWED[-1][0]}, l - {ALLOWED[0][1]}), l + {ALLOWED[0][1]})) AS len FROM v WHERE l >= {ALLOWED[-1][0] - ALLOWED[-1][1]})) WHERE abs(l - len) <= k)),
        start AS (SELECT value, l, len, k, i, w, explode(sequence(lo, hi)) AS at
          FROM (SELECT *, greatest(0, s - i, s + (l - len) - (k - i)) AS lo, least(l - w, s + i, s + (l - len) + (k - i)) AS hi FROM place) WHERE lo <= hi),
        met AS (SELECT DISTINCT x.value, p.name, p.k FROM (SELECT value, len, i, substring(value, at + 1, w) AS part FROM start) x JOIN piece p ON x.len = p.len AND x.i = p.i AND x.part = p.part)
        SELECT value, name, levenshtein(value, name, k) AS dist FROM met WHERE levenshtein(value, name, k) >= 0
        UNION ALL SELECT value, name, 0 FROM v JOIN n ON value = name AND k = 0""",
        values=values,
        names=names,
    )


def listed_names(spark: SparkSession, places: DataFrame) -> DataFrame:
    """(name, kind, place_id, region, country_code): every name of every place; kind is city or country."""
    return spark.sql(
        f"""
        SELECT DISTINCT {_norm("name")} AS name, kind, place_id, upper(trim(region)) AS region, upper(trim(country_code)) AS country_code
        FROM (SELECT *, CASE WHEN city IS NULL THEN 'country' ELSE 'city' END AS kind,
            explode(CASE WHEN city IS NULL THEN concat(array(country_name, country_code), coalesce(split(alt_names, ','), array()))
                         ELSE concat(array(city), coalesce(split(alt_names, ','), array())) END) AS name FROM {{places}} WHERE place_id IS NOT NULL)
        WHERE trim(name) <> ''""",
        places=places.select("place_id", "city", "region", "country_code", "country_name", "alt_names"),
    )


def place_of(spark: SparkSession, typed: DataFrame, places: DataFrame) -> DataFrame:
    """(location, place_id) for each distinct location of `typed` that names a listed place."""
    names = listed_names(spark, places)
    parts = spark.sql(
        rf"""
        WITH l AS (SELECT DISTINCT location FROM {{typed}}),
        seg AS (SELECT location, explode(split({_norm("location")}, '[,;:|/()\\[\\]\n\r]| [-–—] ')) AS s FROM l),
        clean AS (SELECT location, s, regexp_replace(regexp_replace(regexp_replace(trim(s), '^[0-9][0-9 -]* ', ''), '^({BEFORE}) ', ''), ' ({AFTER})$', '') AS c FROM seg)
        SELECT DISTINCT location, value FROM (SELECT location, explode(array(trim(s), trim(c), regexp_replace(trim(c), '^greater ', ''), regexp_replace(trim(c), '[.]', ''))) AS value FROM clean) WHERE value <> ''""",
        typed=typed,
    )
    # both are used several times below: written once to the shared folder, a few short strings for each different location
    parts = cut(parts)
    near = cut(pigeonhole(spark, parts.select("value"), names.select("name")))
    return spark.sql(
        """
        WITH best AS (SELECT value, name, dist FROM (SELECT *, min(dist) OVER (PARTITION BY value) AS low FROM {near}) WHERE dist = low),
        hit AS (SELECT p.location, n.kind, n.place_id, n.region, n.country_code, b.dist FROM {parts} p JOIN best b ON p.value = b.value JOIN {names} n ON b.name = n.name),
        said AS (SELECT location, collect_set(upper(value)) AS codes FROM {parts} WHERE length(value) = 2 GROUP BY location),
        land AS (SELECT location, collect_set(country_code) AS lands, min(place_id) AS land_id FROM hit WHERE kind = 'country' GROUP BY location),
        city AS (SELECT h.location, h.place_id, h.dist, CASE WHEN array_contains(s.codes, h.region) THEN 0 ELSE 1 END AS off
          FROM hit h LEFT JOIN land c ON h.location = c.location LEFT JOIN said s ON h.location = s.location
          WHERE h.kind = 'city' AND (c.lands IS NULL OR array_contains(c.lands, h.country_code))),
        pick AS (SELECT location, min(struct(off, dist, place_id)).place_id AS place_id FROM city GROUP BY location)
        SELECT coalesce(p.location, c.location) AS location, coalesce(p.place_id, c.land_id) AS place_id FROM pick p FULL JOIN land c ON p.location = c.location""",
        near=near,
        parts=parts,
        names=names,
    )


def canonical(spark: SparkSession, jobs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, place_id): the listed place each posting's location names, 0 where it names none.

    Locations that are null or blank give no row. The nearest listed name counts, at most 3 edits off (2 under nine
    letters, 1 under six, none under four); of several cities of a name one in a stated country counts, then one in a stated region, then
    the smallest place_id. If the country named doesn't list the city, or only a country can be told, the country's row. Repeated rows give
    one row; other columns are ignored; with an empty list every row is 0. Locations are made distinct before anything is compared.
    """
    rows = jobs.selectExpr("id", "location").where(r"id is not null and location rlike '[^\\s\\u00a0\\u200b]'").distinct()
    typed = rows.select("location").distinct()
    known = place_of(spark, typed, places)
    unknown = typed.join(known, "location", "left_anti").selectExpr("location", "0L AS place_id")
    return rows.join(known.unionByName(unknown), "location").selectExpr("CAST(id AS BIGINT) AS id", "CAST(place_id AS BIGINT) AS place_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark, table(spark, sf_dir, "jobs"), table(spark, sf_dir, "places"))


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, postings): what names no listed place, most frequent ones to be looked at first."""
    return spark.sql("SELECT j.location, count(*) AS postings FROM {j} j JOIN {f} f ON j.id = f.id WHERE f.place_id = 0 GROUP BY j.location", j=table(spark, sf_dir, "jobs").select("id", "location"), f=found(spark, sf_dir))


_DUCK = rf"""
WITH l AS (SELECT DISTINCT location FROM jobs WHERE regexp_matches(location, '[^\s\x{{00a0}}\x{{200b}}]')),
nm AS (SELECT DISTINCT trim(regexp_replace(lower(strip_accents(name)), '\s+', ' ', 'g')) AS name, kind, place_id, region, country_code FROM (
  SELECT CASE WHEN city IS NULL THEN 'country' ELSE 'city' END AS kind, place_id, region, country_code,
    unnest(CASE WHEN city IS NULL THEN list_concat([country_name, country_code], coalesce(string_split(alt_names, ','), [])) ELSE list_concat([city], coalesce(string_split(alt_names, ','), [])) END) AS name FROM places)
  WHERE trim(name) <> ''),
seg AS (SELECT location, trim(unnest(regexp_split_to_array(trim(regexp_replace(lower(strip_accents(location)), '[\s\x{{00a0}}\x{{200b}}]+', ' ', 'g')), '[,;:|/()\[\]\n\r]| [-–—] '))) AS s FROM l),
clean AS (SELECT location, s, regexp_replace(regexp_replace(regexp_replace(s, '^[0-9][0-9 -]* ', ''), '^({BEFORE}) ', ''), ' ({AFTER})$', '') AS c FROM seg),
parts AS (SELECT DISTINCT location, value FROM (SELECT location, unnest([s, trim(c), regexp_replace(trim(c), '^greater ', ''), replace(trim(c), '.', '')]) AS value FROM clean) WHERE value <> ''),
near AS (SELECT value, name, d FROM (SELECT value, name, levenshtein(value, name) AS d FROM (SELECT DISTINCT value FROM parts), (SELECT DISTINCT name FROM nm)) WHERE d <= CASE WHEN length(name) >= 9 THEN 3 WHEN length(name) >= 6 THEN 2 ELSE 0 END),
best AS (SELECT * FROM near QUALIFY d = min(d) OVER (PARTITION BY value)),
hit AS (SELECT location, nm.kind, place_id, region, country_code, d FROM parts JOIN best USING (value) JOIN nm USING (name) WHERE kind = 'city' OR d <= CASE WHEN length(name) >= 6 THEN 1 ELSE 0 END),
land AS (SELECT location, list(country_code) AS lands, min(place_id) AS land_id FROM hit WHERE kind = 'country' GROUP BY location),
said AS (SELECT location, list(upper(value)) AS codes FROM parts WHERE length(value) = 2 GROUP BY location),
city AS (SELECT h.location, place_id, row_number() OVER (PARTITION BY h.location ORDER BY CASE WHEN list_contains(codes, region) THEN 0 ELSE 1 END, d, place_id) AS k
  FROM hit h LEFT JOIN land c ON h.location = c.location LEFT JOIN said s ON h.location = s.location WHERE kind = 'city' AND (lands IS NULL OR list_contains(lands, country_code))),
f AS (SELECT DISTINCT j.id, CAST(coalesce(city.place_id, land_id, 0) AS BIGINT) AS place_id, j.location FROM jobs j JOIN l USING (location) LEFT JOIN city ON city.location = j.location AND k = 1 LEFT JOIN land ON land.location = j.location)
"""
QUERIES = {"p5_found": found, "p5_unmatched": unmatched}
SQL = {"p5_found": _DUCK + "SELECT id, place_id FROM f", "p5_unmatched": _DUCK + "SELECT location, count(*) AS postings FROM f WHERE place_id = 0 GROUP BY location"}
