"""Quality rules of hosts: rule failures by host, shrunk rates, host verdicts joined back to documents.

A document fails a rule when
  no_words      it has no word (null, empty and blank texts),
  symbols       over 5 % of its characters are of # $ % & * | ! < > { } [ ] \\ ^ ~ _,
  capitals      over 60 % of its letters (at least 20) are capital A-Z or accented capitals,
  repeats       over 30 % of its words (at least 5) equal the word before.
A host is `source`; documents without one are one host. Its failure rate (documents failing any rule) is
shrunk by a beta prior fitted to all hosts' rates by the method of moments: with mean m and variance v of
the rates, strength s = m (1 - m) / v - 1, held to 1..1000 (1000 where v is 0), rate = (failed + s m) / (n + s).
A host is rejected if its shrunk rate is over HOST_LIMIT (one equal to it stays); a document is kept if it passes all rules and
its host is not rejected.

Defined results: every row gets a verdict, repeated rows each; an empty table gives an empty result.
Null doc_ids are kept as they are; other columns are left out of `verdicts` and untouched by `keep`.
The host table has a row for each host. It is counted first: up to BROADCAST_HOSTS rows it is broadcast, so texts don't
move; beyond that, rows of documents and hosts are joined by (host, salt), so that a hot host is spread over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm._shared import cut, documents, spare

HOST_LIMIT = 0.5
BROADCAST_HOSTS, SALTS = 100_000, 64
SYMBOLS = "#$%&*|!<>{}[]\\^~_"
#: Letters of the rule of capitals: those of ASCII and Latin-1.
LETTERS = "".join(chr(c) for a, b in ((65, 91), (97, 123), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x100)) for c in range(a, b))


def counts(text: F.Column) -> tuple[F.Column, ...]:
    """Symbols, capitals, letters, list of words and characters of a text; what few characters match is removed, not what many do."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    capitals = n - F.length(F.regexp_replace(text, "[A-ZÀ-ÖØ-Þ]+", ""))
    letters = n - F.length(F.translate(text, LETTERS, ""))
    words = F.filter(F.split(text, r"[ \n\t\r]+"), lambda w: w != "")
    return symbols, capitals, letters, words, n


def judged(docs: DataFrame, text_col: str = "text", into: str = "voltloom_rules") -> DataFrame:
    """docs with a struct column of the rules that each row fails."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    symbols, capitals, letters, words, n = counts(text)
    part = spare(docs, "voltloom_parts")
    repeats = F.aggregate(part_of(part, "w"), F.struct(F.lit("").alias("last"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("last"), (a["n"] + (a["last"] == w).cast("int")).alias("n")), lambda a: a["n"])
    out = docs.withColumn(part, F.struct(symbols.alias("s"), capitals.alias("c"), letters.alias("l"), words.alias("w"), n.alias("n")))
    size = F.size(part_of(part, "w"))
    rules = F.struct(
        (size == 0).alias("no_words"),
        (part_of(part, "s") * 20 > part_of(part, "n")).alias("symbols"),
        ((part_of(part, "l") >= 20) & (part_of(part, "c") * 10 > part_of(part, "l") * 6)).alias("capitals"),
        ((size >= 5) & (repeats * 10 > size * 3)).alias("repeats"),
    )
    return out.withColumn(into, rules).drop(part)


def part_of(column: str, field: str) -> F.Column:
    return F.col(column)[field]


def hosts(failed: DataFrame) -> DataFrame:
    """(host, n, failed, rate, shrunk, rejected) from (host, fails)."""
    by = cut(failed.groupBy("host").agg(F.count("*").alias("n"), F.count_if("fails").alias("failed")))  # texts are judged once for it and its prior
    by = by.withColumn("rate", F.col("failed") / F.col("n"))
    prior = by.agg(F.avg("rate").alias("m"), F.var_samp("rate").alias("v"))
    strength = F.when(F.coalesce(F.col("v"), F.lit(0.0)) < 1e-12, F.lit(1000.0)).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)))
    by = by.crossJoin(prior.select("m", strength.alias("s")))  # the prior is one row
    return by.select("host", "n", "failed", "rate", ((F.col("failed") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))).alias("shrunk")).withColumn("rejected", F.col("shrunk") > HOST_LIMIT)


def by_host(docs: DataFrame, table: DataFrame, host: str, how: str) -> DataFrame:
    """docs joined with a table of hosts by the column `host`."""
    table = cut(table)
    if table.count() <= BROADCAST_HOSTS:
        return docs.join(F.broadcast(table), host, how)
    salt = spare(docs, "voltloom_salt")
    docs = docs.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return docs.join(table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [host, salt], how).drop(salt)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, four rules, host_docs, host_failed, host_rate, host_rejected, keep) of every document."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{host_col}`"), F.lit("")).alias("host"), F.col(f"`{text_col}`").alias("text"))
    own = cut(judged(slim, "text", "r").select("doc_id", "host", "r.*").withColumn("fails", F.expr("no_words or symbols or capitals or repeats")))  # texts are read once
    table = hosts(own.select("host", "fails")).select("host", F.col("n").alias("host_docs"), F.col("failed").alias("host_failed"), F.round("shrunk", 6).alias("host_rate"), F.col("rejected").alias("host_rejected"))
    return by_host(own, table, "host", "inner").select("doc_id", "host", "no_words", "symbols", "capitals", "repeats", "host_docs", "host_failed", "host_rate", "host_rejected", (~F.col("fails") & ~F.col("host_rejected")).alias("keep"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that are kept, with their columns."""
    rules, host = spare(docs, "voltloom_rules"), spare(docs, "voltloom_host")
    own = judged(docs, text_col, rules).withColumn(host, F.coalesce(F.col(f"`{host_col}`"), F.lit("")))
    own = own.withColumn(rules, F.col(rules)["no_words"] | F.col(rules)["symbols"] | F.col(rules)["capitals"] | F.col(rules)["repeats"])
    bad = hosts(own.select(F.col(host).alias("host"), F.col(rules).alias("fails"))).filter("rejected").select(F.col("host").alias(host))
    return by_host(own.filter(~F.col(rules)), bad, host, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, host, length(text) AS n,
    length(text) - length(translate(text, '#$%&*|!<>{}[]\^~_', '')) AS s,
    length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS c,
    length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]+', '', 'g')) AS l,
    list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS w FROM t),
q AS (SELECT *, len(w) AS size, len(list_filter(list_zip(w, list_concat([''], w[:-2])), lambda z: z[1] = z[2])) AS again FROM p),
r AS (SELECT doc_id, host, size = 0 AS no_words, s * 20 > n AS symbols, l >= 20 AND c * 10 > l * 6 AS capitals,
    size >= 5 AND again * 10 > size * 3 AS repeats FROM q),
f AS (SELECT *, no_words OR symbols OR capitals OR repeats AS fails FROM r),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE fails) AS failed, count(*) FILTER (WHERE fails) / count(*) AS rate FROM f GROUP BY host),
m AS (SELECT avg(rate) AS m, CASE WHEN coalesce(var_samp(rate), 0) < 1e-12 THEN 1000.0
    ELSE least(1000.0, greatest(1.0, avg(rate) * (1 - avg(rate)) / var_samp(rate) - 1)) END AS s FROM h),
k AS (SELECT host, n, failed, (failed + s * m) / (n + s) AS shrunk FROM h, m)
SELECT doc_id, host, no_words, symbols, capitals, repeats, n AS host_docs, failed AS host_failed, round(shrunk, 6) AS host_rate,
    shrunk > 0.5 AS host_rejected, NOT fails AND NOT (shrunk > 0.5) AS keep
FROM f JOIN k USING (host)
"""
