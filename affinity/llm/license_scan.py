"""License scans: sparse TF-IDF cosine of headers and licence files to templates,
then inheritance from the nearest ancestor directory. DataFrame functions only.

Units of a file are its lines, its blocks (lines between lines without words, so
that comment signs alone end a block too) and the file as a whole. A unit's vector
has a 1 for each distinct template word, times the word's idf over all lines of
all files. Words that no template has are counted by line (distinct ones in each)
and have the idf of a word of one line. Squared idfs are whole millionths, so sums
do not depend on their order. A unit is of the template with the highest cosine of
at least ``least`` (of several the lowest rank, then the smallest name), a file of
its unit with the lowest rank (0 a licence by name and version, 1 one of them open,
2 rights reserved), then the highest cosine, then the smallest name: the title block
of a licence text decides its version, however near a single line of it is to other
versions, and a licence goes before the rights reserved beside it. A notice of a
licence that no template names is nearer to one without a name and is 'Other', or
none where its own words outweigh the notice's (``EUPL-1.2`` in a tag).

Texts are read and cut into words once; what is written in the shared folder, of
each file, is the template words and the number of others of each line. Only units
that can reach the threshold are multiplied out: those that hold one of the words
without which every template is too far, and have not too many other words.

A licence file (by its name, or because a file of several lines matches as a whole)
gives its directory a licence: of several the lowest rank, then the highest cosine, then the smallest path.
Directories take the licence of their nearest ancestor that has one, themselves
included, by a join of directory paths; files without a licence of their own take
their directory's. Each directory is looked up once, so a directory with a third
of all files costs one row in that join; the files then meet one row for each
directory, a join that adaptive execution splits where it is skewed.

The templates are a short list given with the call and are broadcast; the
corpus statistics that go through the driver are one number for each template
word.

Edge cases: null and empty texts have no own licence but may inherit; a null
path has no directory and inherits nothing; equal paths are separate files (rows
are not merged, and only ``keep`` columns come back), a licence of one of several
rows with equal paths and ``keep`` columns counts for all of them; ties as above.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.session import scratch_path

from .common import cut
from .licence_texts import default_templates

WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
GAP = r"\n[^a-z0-9]*\n"
LEAST = 0.7
UNIT = 1_000_000


def template_words(templates: list[tuple[str, int, str]]) -> list[tuple[str, int, list[str]]]:
    return [(name, rank, sorted(set(re.findall(WORD, text.lower())))) for name, rank, text in templates]


def reduced(text: Column, vocabulary: list[str]) -> Column:
    """Blocks of lines with words; of each line its distinct template words and the
    number of others."""
    words = F.transform(F.split(F.lower(text), GAP, -1), lambda block: F.filter(
        F.transform(F.split(block, "\n", -1),
                    lambda line: F.array_distinct(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))),
        lambda ws: F.size(ws) > 0))
    return F.transform(F.filter(words, lambda b: F.size(b) > 0), lambda block: F.transform(
        F.transform(block, lambda ws: F.struct(F.filter(ws, lambda w: w.isin(vocabulary)).alias("hits"),
                                               F.size(ws).alias("n"))),
        lambda line: F.struct(line["hits"].alias("hits"), (line["n"] - F.size(line["hits"])).alias("others"))))


def joined(lines: Column) -> Column:
    """Some lines as one unit."""
    return F.struct(F.array_distinct(F.flatten(lines["hits"])).alias("hits"),
                    F.aggregate(lines["others"], F.lit(0), lambda a, n: a + n).alias("others"))


def decisive(words: list[str], square: dict[str, int], least: float) -> list[str]:
    """Words of a template without all of which a unit can't reach the threshold:
    the rest of its mass is too small."""
    rest, out = sum(square[w] for w in words), []
    mass = rest
    for w in sorted(words, key=lambda w: (-square[w], w)):
        if rest < (least - 1e-6) ** 2 * (1 - 1e-9) * mass:
            break
        rest -= square[w]
        out.append(w)
    return out


def scan_licences(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (),
                  templates: list[tuple[str, int, str]] | None = None, least: float = LEAST) -> DataFrame:
    """``keep`` columns, path, own_licence, cosine, licence, origin ('own',
    'directory' or null) of every file. ``templates``: (licence, rank, text)."""
    spark = files.sparkSession
    wanted = template_words(templates or default_templates())
    vocabulary = sorted({w for _, _, ws in wanted for w in ws})
    base = files.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)),
                        F.col(f"`{path_col}`").cast("string").alias("path"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    slim = base.withColumn("file", F.struct("path", *(f"k{i}" for i in range(len(keep))))).drop("text")
    path = scratch_path(spark, "licence_words")
    (base.select(F.struct("path", *(f"k{i}" for i in range(len(keep)))).alias("file"),
                 reduced(F.col("text"), vocabulary).alias("blocks"))
     .filter(F.size("blocks") > 0).write.parquet(path))
    read = spark.read.parquet(path)
    blocks = F.col("blocks")
    lines = F.flatten(blocks)

    # idf of the template words over all lines
    counted = (read.select(F.explode(F.flatten(F.transform(lines, lambda x: F.concat(F.array(F.lit("")), x["hits"])))).alias("word"))
               .groupBy("word").count().collect())
    df = {r["word"]: r["count"] for r in counted}
    total = df.get("", 0)

    def idf_squared(n: int) -> int:
        idf = math.log((1 + total) / (1 + n)) + 1.0
        return math.floor(UNIT * (idf * idf))

    square = {w: idf_squared(df.get(w, 0)) for w in vocabulary}
    other = idf_squared(1)
    norm = [sum(square[w] for w in ws) for _, _, ws in wanted]
    matrix = F.broadcast(spark.createDataFrame(
        [(t, name, rank, w, square[w], norm[t]) for t, (name, rank, ws) in enumerate(wanted) for w in ws],
        "template int, licence string, rank int, word string, weight long, norm long"))
    squares = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, square[w])])
    needed = sorted({w for _, _, ws in wanted for w in decisive(ws, square, least)})
    most = int(max(norm) / (least - 1e-6) ** 2 / other) + 1

    # numbered units: the best one of a file is found without its text
    units = F.concat(
        F.when(F.size(lines) > 1, F.array(joined(lines))).otherwise(F.array(F.struct(F.array(F.lit("")).alias("hits"), F.lit(0).alias("others")))),
        lines, F.transform(F.filter(blocks, lambda b: F.size(b) > 1), joined))
    able = (read.filter(F.exists(lines, lambda x: F.exists(x["hits"], lambda w: w.isin(needed))))
            .select("file", F.posexplode(units).alias("unit", "held"))
            .select("file", "unit", F.col("held.hits").alias("hits"), F.col("held.others").alias("others"))
            .filter(F.col("others") <= most).filter(F.exists("hits", lambda w: w.isin(needed)))
            .withColumn("square", F.aggregate("hits", F.lit(0).cast("long"), lambda a, w: a + F.element_at(squares, w))
                        + F.col("others").cast("long") * F.lit(other))
            .select("file", "unit", "square", F.explode("hits").alias("word")))
    scored = (able.join(matrix, "word").groupBy("file", "unit", "template")
              .agg(F.first("licence").alias("licence"), F.first("rank").alias("rank"),
                   (F.sum("weight") / F.sqrt(F.first("norm").cast("double") * F.first("square").cast("double"))).alias("cosine"))
              .withColumn("cosine", F.round("cosine", 6)).filter(F.col("cosine") >= least))
    judged = (scored.groupBy("file", "unit").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "rank", "licence")).alias("u"))
              .select("file", "unit", F.struct("u.rank", "u.c", "u.licence").alias("u")))
    best = (judged.groupBy("file").agg(F.min("u").alias("top"), F.min(F.when(F.col("unit") == 0, F.col("u"))).alias("whole"))
            .select("file", "top", "whole", F.col("top.licence").alias("own_licence"), (-F.col("top.c")).alias("cosine")))
    best = cut(best)  # one row for each file with a licence; met twice below
    marked = (slim.join(best.select(F.col("file").alias("f"), "own_licence", "cosine"),
                        F.col("file").eqNullSafe(F.col("f")), "left").drop("f"))
    marked = marked.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))

    # licences of directories, then of every directory below them
    named = F.col("path").rlike(r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$")
    given = (best.select(F.col("file.path").alias("path"), "top", "whole")
             .filter(F.col("path").isNotNull()).filter(named | F.col("whole").isNotNull())
             .select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("at"), "path", F.when(named, F.col("top")).otherwise(F.col("whole")).alias("u"))
             .groupBy("at").agg(F.min(F.struct("u.rank", "u.c", "path", "u.licence")).alias("near"))
             .select("at", F.col("near.licence").alias("dir_licence")))
    steps = F.split("dir", "/")
    ancestors = (base.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).filter("dir IS NOT NULL").distinct()
                 .select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)),
                                                      lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("at")))
    nearest = (ancestors.join(given, "at").groupBy("dir")
               .agg(F.max(F.struct(F.length("at").alias("n"), "dir_licence")).alias("near"))
               .select("dir", F.col("near.dir_licence").alias("dir_licence")))
    out = marked.join(nearest, "dir", "left")
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "path", "own_licence", "cosine",
        F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "directory").alias("origin"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language, groups of neighbouring ids.
    A document that begins or ends with a line on its licence stands for its
    directory's licence file."""
    ends = F.concat(F.substring_index("text", "\n", 1), F.lit(" "), F.substring_index("text", "\n", -1))
    name = F.when(ends.rlike("(?i)licen[cs]e"), F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(
        F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")),
                    F.lit("/"), F.floor(F.col("doc_id") / 64), F.lit("/"), name)
    return docs.select("doc_id", path.alias("path"), "text")


def oracle() -> str:
    """The query over ``documents`` in DuckDB SQL."""
    rows = ", ".join(f"({t}, '{name}', {rank}, '{w}')"
                     for t, (name, rank, ws) in enumerate(template_words(default_templates())) for w in ws)
    up = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
    return f"""
WITH tpl(template, licence, rank, word) AS (VALUES {rows}),
vocab AS (SELECT list(DISTINCT word) AS v FROM tpl),
files AS (SELECT doc_id, '/' || coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/'
    || CAST(floor(doc_id / 64) AS BIGINT) || '/'
    || CASE WHEN regexp_matches(split_part(text, chr(10), 1) || ' ' || split_part(text, chr(10), -1), '(?i)licen[cs]e') THEN 'LICENSE-' || doc_id
            ELSE doc_id || '.txt' END AS path, coalesce(text, '') AS text FROM documents),
cutup AS (SELECT doc_id, path, string_split_regex(lower(text), '{GAP}') AS bs FROM files),
b AS (SELECT doc_id, path, unnest(range(len(bs))) AS b, unnest(bs) AS block FROM cutup),
sp AS (SELECT doc_id, path, b, string_split(block, chr(10)) AS ls FROM b),
l AS (SELECT doc_id, path, b, unnest(range(len(ls))) AS l,
             list_distinct(regexp_extract_all(unnest(ls), '{WORD}')) AS words FROM sp),
lines AS (SELECT doc_id, path, b, l, list_intersect(words, v) AS hits, len(words) AS n FROM l, vocab WHERE len(words) > 0),
total AS (SELECT count(*) AS n FROM lines),
df AS (SELECT word, count(*) AS n FROM (SELECT unnest(hits) AS word FROM lines) GROUP BY word),
idf AS (SELECT t.word, ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1.0 AS x
        FROM (SELECT DISTINCT word FROM tpl) t LEFT JOIN df USING (word), total),
sq AS (SELECT word, CAST(floor({UNIT} * (x * x)) AS BIGINT) AS s FROM idf),
other AS (SELECT CAST(floor({UNIT} * (x * x)) AS BIGINT) AS o FROM (SELECT ln((1 + n) / 2) + 1.0 AS x FROM total)),
norms AS (SELECT template, sum(s) AS norm FROM tpl JOIN sq USING (word) GROUP BY template),
member AS (SELECT doc_id, path, 'l' || b || '.' || l AS unit, hits, n FROM lines
           UNION ALL SELECT doc_id, path, 'b' || b, hits, n FROM lines
           UNION ALL SELECT doc_id, path, 'w', hits, n FROM lines),
sizes AS (SELECT doc_id, path, unit, sum(n - len(hits)) AS others, count(*) AS k FROM member GROUP BY ALL
          HAVING k > 1 OR unit LIKE 'l%'),
h AS (SELECT DISTINCT doc_id, path, unit, word FROM (SELECT doc_id, path, unit, unnest(hits) AS word FROM member)),
squares AS (SELECT doc_id, path, unit, sum(s) + any_value(others) * any_value(o) AS square
            FROM h JOIN sizes USING (doc_id, path, unit) JOIN sq USING (word), other GROUP BY doc_id, path, unit),
scored AS (SELECT doc_id, path, unit, template, any_value(licence) AS licence, any_value(rank) AS rank,
                  round(sum(s) / sqrt(CAST(any_value(norm) AS DOUBLE) * CAST(any_value(square) AS DOUBLE)), 6) AS cosine
           FROM h JOIN sq USING (word) JOIN tpl USING (word) JOIN norms USING (template) JOIN squares USING (doc_id, path, unit)
           GROUP BY doc_id, path, unit, template),
judged AS (SELECT doc_id, path, unit, min(row(-cosine, rank, licence)) AS u FROM scored WHERE cosine >= {LEAST}
           GROUP BY doc_id, path, unit),
ranked AS (SELECT doc_id, path, unit, row(u[2], u[1], u[3]) AS u FROM judged),
own AS (SELECT doc_id, path, min(u) AS top, min(CASE WHEN unit = 'w' THEN u END) AS whole,
               regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$') AS named FROM ranked GROUP BY doc_id, path),
picked AS (SELECT path, CASE WHEN named THEN top ELSE whole END AS u FROM own WHERE named OR whole IS NOT NULL),
given AS (SELECT {up} AS place, min(row(u[1], u[2], path, u[3])) AS top FROM picked GROUP BY 1),
dirs AS (SELECT DISTINCT {up} AS dir FROM files),
anc AS (SELECT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS place
        FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM dirs)),
near AS (SELECT dir, max(row(length(anc.place), top[4])) AS near FROM anc JOIN given USING (place) GROUP BY dir)
SELECT f.doc_id, f.path, top[3] AS own_licence, -top[2] AS cosine, coalesce(top[3], near[2]) AS licence,
       CASE WHEN top IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'directory' END AS origin
FROM files f LEFT JOIN own USING (doc_id, path) LEFT JOIN near ON near.dir = {up.replace('path', 'f.path')}"""
