"""Licence recognition by sentence rules: known sentences give identifiers, ordered identifiers give licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table


def _tsv(name: str) -> list[tuple[str, str]]:
    return [tuple(line.split("\t")) for line in (Path(__file__).parent / name).read_text(encoding="utf-8").splitlines()]


#: (identifier, sentence): sentences of licence texts and notices, as they are published.
SENTENCES = _tsv("licence_sentences.tsv")
#: (licence, identifiers in order). Rules are tried from the longest to the shortest, then as they stand; what one has matched no other uses.
RULES = [(licence, ids.split(" ")) for licence, ids in _tsv("licence_rules.tsv")]

#: A sentence ends at a mark before a blank or a line break, and at an empty line (or one of comment signs only). Other line breaks wrap it.
END = r"[.!?;:][ \t\r]*\n|[.!?;:][ \t]+|\n[ \t\r]*[#*/;-]*[ \t\r]*\n"
#: What remains when all but letters, digits and the dots and hyphens between them is a blank.
NOISE = r"[^\p{L}\p{N}.-]+|[.-]+(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[.-]+"
HINT = "licen[cs]e"
#: Bytes of the sentence table up to which each executor gets it, so that sentences of documents aren't shuffled.
MOST_BROADCAST = 8 << 20
#: Sentences with parts of their own, such as the holder's name: (words that they have, pattern of the normalised beginning, beginning of the known sentence).
FORMS = [
    ("nor the names of", r"^(?:[0-9]{1,2} )?neither the names? of .{1,200}? nor the names of (?:its|their|any|the|other) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("may not be used to endorse", r"^(?:[0-9]{1,2} )?the names? of .{1,200}? may not be used to endorse", "the name of the author may not be used to endorse"),
    ("redistributions", r"^[0-9]{1,2} redistributions ", "redistributions "),
]


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_lower(sentence), NOISE, " "), " {2,}", " "))


def canonical(normal: Column) -> Column:
    """A normalised sentence with the parts of its own replaced by those of the known sentence."""
    for words, pattern, known in FORMS:
        normal = F.when(F.contains(normal, F.lit(words)), F.regexp_replace(normal, pattern, known)).otherwise(normal)
    return normal


def scan_licences(docs: DataFrame, sentences: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences, unknown), a row for each row of docs.

    sentences: (identifier, sentence); rules: (place, licence, ids array<string>), a few hundred of them. A sentence
    may be wrapped over lines; where it is not known as a whole, each of its lines is tried as one, since
    notices often stand on a line of their own. sentence_ids: identifiers in text order, joined by commas;
    licences: those of the rules that match the sequence, sorted, joined by commas; unknown: sentences that
    speak of a licence and have no known part. A sentence that stands twice in the table has the least identifier; of rules
    of one length the first comes first. Null and empty texts have empty lists. Rows that repeat an id and a text
    have equal results. A very long text is cut whole into its sentences, a row each. Empty tables give
    empty results. Other columns of docs aren't looked at.
    """
    known = sentences.select(normalise(F.col("sentence")).alias("s"), "identifier").select(canonical(F.col("s")).alias("s"), "identifier").groupBy("s").agg(F.min("identifier").alias("identifier"))
    if (known.agg(F.sum(F.octet_length("s") + F.octet_length("identifier"))).first()[0] or 0) <= MOST_BROADCAST:
        known = F.broadcast(known)  # else both sides are dealt by the sentence
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    cut = rows.select("doc_id", "h", F.posexplode(F.split("text", END)).alias("at", "s")).where(F.col("s") != "")
    lines = F.when(F.contains("s", F.lit("\n")), F.split("s", "\n")).otherwise(F.array().cast("array<string>"))
    tried = cut.select("doc_id", "h", "at", F.posexplode(F.concat(F.array("s"), lines)).alias("line", "s")).select("doc_id", "h", "at", "line", normalise(F.col("s")).alias("s"))
    tried = tried.withColumn("s", canonical(F.col("s")))
    speaks = (F.col("line") == 0) & F.col("s").rlike(HINT)
    found = tried.join(known, "s", "left").where(F.col("identifier").isNotNull() | speaks)
    found = found.select("doc_id", "h", F.struct("at", "line", "identifier").alias("x")).distinct()
    seq = found.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    named = F.filter("xs", lambda x: x["identifier"].isNotNull())
    # a sentence known as a whole isn't also read by its lines
    whole = F.transform(F.filter(named, lambda x: x["line"] == 0), lambda x: x["at"])
    seq = seq.select("doc_id", "h", "xs", named.alias("named"), whole.alias("whole"))
    ids = F.transform(F.filter("named", lambda x: (x["line"] == 0) | ~F.array_contains("whole", x["at"])), lambda x: x["identifier"])
    places = F.transform("named", lambda x: x["at"])
    unknown = F.size(F.filter("xs", lambda x: x["identifier"].isNull() & ~F.array_contains(places, x["at"])))
    seq = seq.select("doc_id", "h", F.array_join(ids, ",").alias("sentence_ids"), unknown.cast("long").alias("unknown"))
    # an identifier stands between two commas of its own; a rule that is found leaves a mark, so that none reaches across it
    left = F.when(F.col("sentence_ids") != "", F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(","))).otherwise(F.lit(""))
    pattern = F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))
    ordered = rules.select((-F.size("ids")).alias("k"), "place", "licence", pattern.alias("pattern")).agg(F.sort_array(F.collect_list(F.struct("k", "place", "licence", "pattern"))).alias("r")).scalar()
    seq = seq.withColumn("_rules", F.coalesce(ordered, F.array().cast("array<struct<k: int, place: int, licence: string, pattern: string>>")))
    start = F.struct(left.alias("left"), F.array().cast("array<string>").alias("got"))
    step = lambda s, r: F.when(F.contains(s["left"], r["pattern"]), F.struct(F.replace(s["left"], r["pattern"], F.lit(",-,")).alias("left"), F.array_append(s["got"], r["licence"]).alias("got"))).otherwise(s)
    got = F.when(F.col("sentence_ids") != "", F.aggregate("_rules", start, step)["got"]).otherwise(F.array().cast("array<string>"))
    seq = seq.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), "sentence_ids", F.array_join(F.array_sort(F.array_distinct(got)), ",").alias("licences"), "unknown")
    out = rows.select("doc_id", "h").join(seq, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    return out.select("doc_id", F.coalesce("sentence_ids", F.lit("")).alias("sentence_ids"), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("unknown", F.lit(0).cast("long")).alias("unknown"))


def known_sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENTENCES, "identifier string, sentence string")


def known_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "place int, licence string, ids array<string>")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of all documents, by the published sentences and rules of the two tables beside this module."""
    return scan_licences(table(spark, sf_dir, "documents"), known_sentences(spark), known_rules(spark))


def _values(rows: list) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _op3_sql() -> str:
    noise = lambda s: rf"regexp_replace(regexp_replace(regexp_replace(' ' || translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '[^\p{{L}}\p{{N}}.-]+', ' ', 'g'), '[.-]+ ', ' ', 'g'), ' [.-]+', ' ', 'g')"
    norm = lambda s: canon(f"trim(regexp_replace({noise(s)}, ' {{2,}}', ' ', 'g'), ' ')")

    def canon(s: str) -> str:
        for _, pattern, known in FORMS:
            s = f"regexp_replace({s}, '{pattern}', '{known}')"
        return s

    steps, at = [], "first_step"
    for k, (licence, rule) in enumerate(sorted(RULES, key=lambda r: -len(r[1]))):
        pattern = "".join(f",{x}," for x in rule)
        steps.append(f"step{k} as (select doc_id, sentence_ids, unknown, replace(l, '{pattern}', ',-,') as l, case when contains(l, '{pattern}') then list_append(got, '{licence}') else got end as got from {at})")
        at = f"step{k}"
    end = END.replace("'", "''")
    return f"""
with known as (select {norm("sentence")} as s, min(identifier) as identifier from (values {_values(SENTENCES)}) t(identifier, sentence) group by 1),
pieces as (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '{end}')) as s, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '{end}'), 1) as pos from documents),
tried as (select doc_id, pos, 0 as line, s from pieces union all
    select doc_id, pos, generate_subscripts(string_split(s, chr(10)), 1), unnest(string_split(s, chr(10))) from pieces where contains(s, chr(10))),
found as (select doc_id, pos, line, identifier, {norm("tried.s")} as n from tried left join known on {norm("tried.s")} = known.s),
per as (select *, max(case when line = 0 and identifier is not null then 1 else 0 end) over (partition by doc_id, pos) as whole, max(case when identifier is not null then 1 else 0 end) over (partition by doc_id, pos) as partly from found),
seq as (select doc_id, coalesce(string_agg(identifier, ',' order by pos, line) filter (where identifier is not null and (line = 0 or whole = 0)), '') as sentence_ids,
    count(*) filter (where line = 0 and partly = 0 and regexp_matches(n, '{HINT}')) as unknown from per group by doc_id),
first_step as (select doc_id, sentence_ids, unknown, case when sentence_ids <> '' then ',' || replace(sentence_ids, ',', ',,') || ',' else '' end as l, []::varchar[] as got from seq),
{", ".join(steps)}
select doc_id, sentence_ids, array_to_string(list_sort(list_distinct(got)), ',') as licences, unknown::bigint as unknown from {at}
"""


OP3_SQL = _op3_sql()
