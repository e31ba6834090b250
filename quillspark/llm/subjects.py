"""Subject areas of texts by propagating labels over a similarity graph of documents.

Documents are neighbours through what they share: a document is joined to its phrases, and a phrase to its terms (words
and pairs of words), so that a large group of similar documents is a star and not all its pairs. Labelled documents are
the seeds. First all seeds vote: a term that enough of them hold takes the subject that most of these bear. A phrase takes
the subject its terms agree on; that link is verified by at least two terms and most of their weight, so one shared word
makes none. Seeds whose own phrases then say what their labels say are trusted; the others are released and count no
more. The votes are taken again among trusted seeds, and from these on labels spread by joins, round by round, from
phrases to terms that no seed holds and on to the phrases of further documents, until nothing changes. Trusted seeds
stay clamped, in every round and in the result; a document keeps the subjects of all its phrases. Terms that the seeds
show to be of no subject (mediums, light, materials) drop out of the graph at once, and with them most phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise, spread

#: Longest phrase in words that is taken whole; a longer one is read through windows of WINDOW words, STEP apart.
LONG, WINDOW, STEP = 14, 8, 4
#: A term needs so many seeds, and its subject so large a share of them; from phrases, so many phrases and this share.
SEEDS, PURITY, PHRASES, PHRASE_PURITY = 4, 0.65, 3, 0.7
#: A phrase needs so many terms and so much weight for its subject, and this share of all weight.
TERMS, WEIGHT, MAJORITY = 2, 1.0, 0.6
#: Rounds that cannot be needed: each takes up terms for good, and none has ever needed more than a few.
ROUNDS = 50
_BREAKS = "[,.;:!?|\\n\\r\"“”„(){}\\[\\]—–…•<>/\\\\]+|\\s-\\s|\\s--"


def with_phrases(df: DataFrame, text: Column) -> DataFrame:
    """df with phrases, the distinct phrases of a text: lower case, underscores as spaces, cut at punctuation; windows of a
    long one. The cut text passes through a generator, as it is used twice and would be worked out twice."""
    t = F.regexp_replace(F.translate(F.lower(F.upper(text)), "_‐‑", " --"), _BREAKS, "\u0001")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), " ?\u0001[\u0001 ]*", "\u0001")
    b = df.select("*", F.explode(F.array(F.split(F.btrim(t, F.lit(" \u0001")), "\u0001"))).alias("_parts"))
    spaces = lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))

    def windows(p: Column) -> Column:
        w = F.split(p, " ")
        return F.transform(F.sequence(F.lit(1), F.size(w) - STEP, F.lit(STEP)), lambda i: F.array_join(F.slice(w, i, WINDOW), " "))

    whole = F.filter("_parts", lambda p: (p != "") & (spaces(p) < LONG))
    cut = F.flatten(F.transform(F.filter("_parts", lambda p: spaces(p) >= LONG), windows))
    return b.select("*", F.array_distinct(F.concat(whole, cut)).alias("phrases")).drop("_parts")


def terms(phrase: Column) -> Column:
    """The distinct words and pairs of neighbouring words of a phrase, as hashes."""
    w = F.split(phrase, " ")
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(w, pairs), lambda x: F.xxhash64(x)))


def _weight(k: str, n: str) -> Column:
    """The square of a cautious share k of n: one standard error, at least half a case, below it."""
    return F.expr(f"pow(greatest(0, ({k} - sqrt({k} * (1 - {k} / {n}) + 0.25)) / {n}), 2)")


def _phrase_subjects(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(phrase, subject) for each phrase whose terms agree."""
    sums = edges.join(known, "term").groupBy("phrase", "subject").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    best = sums.groupBy("phrase").agg(F.sum("w").alias("all"), F.max(F.struct("w", "n", "subject")).alias("b"))
    return best.where((F.col("b.n") >= TERMS) & (F.col("b.w") >= WEIGHT) & (F.col("b.w") >= MAJORITY * F.col("all"))).select("phrase", F.col("b.subject").alias("subject"))


def _votes(held: DataFrame, named: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(term, n, subject, k): of each term that enough seeds hold (those of `every`, if given, released ones too), how many of
    held do and how many of them bear a subject."""
    n = held.groupBy("term").agg(F.count("*").alias("n"))
    enough = (held if every is None else every).groupBy("term").agg(F.count("*").alias("_all")).where(F.col("_all") >= SEEDS).select("term")
    n = n.join(enough, "term", "left_semi")
    k = held.join(named, "record_id").groupBy("term", "subject").agg(F.count("*").alias("k"))
    return n.join(k, "term", "left").fillna(0, ["k"])


def _decided(votes: DataFrame) -> DataFrame:
    return votes.where(F.col("k") >= PURITY * F.col("n")).select("term", "subject", _weight("k", "n").alias("weight"))


def _of_phrases(phrases: DataFrame) -> DataFrame:
    """(phrase, term) of distinct phrases p."""
    return phrases.distinct().select(F.xxhash64("p").alias("phrase"), F.explode(terms(F.col("p"))).alias("term"))


def trusted_seeds(seeds: DataFrame, named: DataFrame, known: DataFrame) -> DataFrame:
    """(record_id) of seeds (record_id, phrases) whose phrases, by what all seeds say of their terms, have the subjects that
    they are labelled with: all of these, and no other."""
    marked = _phrase_subjects(_of_phrases(seeds.select(F.explode("phrases").alias("p"))), known)
    own = seeds.select("record_id", F.explode(F.transform("phrases", lambda p: F.xxhash64(p))).alias("phrase"))
    found = own.join(marked, "phrase").select("record_id", "subject").distinct().withColumn("found", F.lit(True))
    wrong = named.withColumn("named", F.lit(True)).join(found, ["record_id", "subject"], "full_outer").where("named is null or found is null")
    return seeds.select("record_id").distinct().join(wrong.select("record_id").distinct(), "record_id", "left_anti")


def assign(records: DataFrame, labels: DataFrame, id_col: str, text_cols: list[str], subjects: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(record_id, subject), distinct, for every record and every subject found in it.

    labels: (record_id, subject) in any case, with `none` for a record of no subject; subjects (subject), if given, limits
    them. Trusted labels hold as they are; wrong ones are outvoted by the other seeds and released. Records with a null id, whose
    first text is null or blank, have none; further texts are read with it. Without labels the result is empty. More
    than `rounds` rounds raise."""
    first = records[text_cols[0]]
    text = F.concat_ws("\n", *[records[c] for c in text_cols])
    parsed = materialise(
        with_phrases(spread(records.where(records[id_col].isNotNull() & first.rlike(r"\S")).select(records[id_col].cast("bigint").alias("record_id"), text.alias("_text"))), F.col("_text")).drop("_text"),
        "subjects-phrases",
    )
    given = labels.select(F.col("record_id").cast("bigint").alias("record_id"), F.lower(F.trim("subject")).alias("subject")).where("record_id is not null and subject is not null").distinct()
    named = given.where(F.col("subject") != "none")
    if subjects is not None:
        named = named.join(subjects.select(F.lower(F.trim("subject")).alias("subject")).distinct(), "subject", "left_semi").select("record_id", "subject")
    seeds = materialise(parsed.join(given.select("record_id").distinct(), "record_id", "left_semi"), "subjects-seeds")
    named = materialise(named.join(seeds.select("record_id").distinct(), "record_id", "left_semi"), "subjects-named")
    held = materialise(seeds.select("record_id", F.explode(F.array_distinct(F.flatten(F.transform("phrases", terms)))).alias("term")), "subjects-held")
    trusted = materialise(trusted_seeds(seeds, named, _decided(_votes(held, named))), "subjects-trusted")
    clamped = materialise(named.join(trusted, "record_id", "left_semi"), "subjects-clamped")
    votes = materialise(_votes(held.join(trusted, "record_id", "left_semi"), clamped, held), "subjects-votes")
    known = materialise(_decided(votes), "subjects-known")
    seen = votes.select("term").distinct()
    settled = seen.join(known.select("term"), "term", "left_anti")

    edges = _of_phrases(parsed.select(F.explode("phrases").alias("p")))
    edges = materialise(edges.join(settled, "term", "left_anti"), "subjects-edges")
    for _ in range(rounds):
        marked = materialise(_phrase_subjects(edges, known), "subjects-marked")
        by = edges.join(seen, "term", "left_anti").join(marked, "phrase", "left").groupBy("term", "subject").agg(F.count("*").alias("k"))
        total = by.groupBy("term").agg(F.sum("k").alias("n"), F.max(F.when(F.col("subject").isNotNull(), F.struct("k", "subject"))).alias("b"))
        taken = total.where((F.col("b.k") >= PHRASES) & (F.col("b.k") >= PHRASE_PURITY * F.col("n"))).select("term", F.col("b.subject").alias("subject"), _weight("b.k", "n").alias("weight"))
        taken = materialise(taken, "subjects-taken")
        if taken.isEmpty():
            break
        known, seen = known.unionByName(taken), seen.unionByName(taken.select("term"))
    else:
        raise RuntimeError(f"labels still spread after {rounds} rounds")
    found = parsed.select("record_id", F.explode(F.transform("phrases", lambda p: F.xxhash64(p))).alias("phrase")).join(marked, "phrase").select("record_id", "subject").distinct()
    return found.join(trusted, "record_id", "left_anti").unionByName(clamped.select("record_id", "subject"))


def composition(records: DataFrame, assigned: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(subject, records, share) of all records with a text, `none` for those without a subject."""
    whole = records.where(records[id_col].isNotNull() & records[text_col].rlike(r"\S")).select(records[id_col].cast("bigint").alias("record_id"))
    total = whole.agg(F.count("*").alias("total"))
    each = whole.join(assigned, "record_id", "left").groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("records"))
    return each.crossJoin(F.broadcast(total)).select("subject", "records", (F.col("records") / F.col("total")).alias("share"))
