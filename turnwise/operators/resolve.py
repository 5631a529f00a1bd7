"""Typed course names to courses, as a layered join over distinct query texts.

Each text becomes a few spelling variants, each variant a few (subject, number)
readings; readings meet the vocabulary and the course index by equality, and
the least forgiving hit wins. Misspelt subjects are tried last and only against
subjects that have a course with the number asked for.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.special import osa_distance

# Match layers from least to most forgiving, filler and stop words.
LAYERS = ("exact", "alias", "name", "nickname", "filler", "split", "bare", "fuzzy", "title", "miss")
FILLER = ("CLASS", "COURSE", "LEC", "LECTURE", "DIS", "DISCUSSION", "LAB", "SPRING", "FALL", "SUMMER")
STOP_WORDS = ("THE", "AND", "OF", "TO", "IN", "A", "AN", "FOR", "WITH", "ON")
# Fixed values, patterns.
_PARTING = "[^A-Z0-9&]+"  # parts a typed text
_LOOSE = r"[\s&]+"  # what a squashed text lacks
_YEAR = r"\d{4}"
_SUFFIX = r"(\d)\s+([A-Z])$"  # a lone letter after a number
#: Subject with number, and a subject's cross-listing letter.
_PAIR = r"^([A-Z&][A-Z&\s]*?)\s*(\d+[A-Z]*)$"
_CROSS = r"^(.*?)\s?([CHNRW])$"


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), _PARTING, " "))


def squash(text: Column) -> Column:
    return F.regexp_replace(text, _LOOSE, "")


def strip_filler(text: Column, words: Sequence[str] = FILLER) -> Column:
    """Drop filler words and four-digit years. Institution words are passed in by the caller."""
    pattern = r"^(" + "|".join([*words, _YEAR]) + r")$"
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~w.rlike(pattern)), " ")


def split_suffix(text: Column) -> Column:
    """A lone last letter belongs to the number before it: ``61 A`` is ``61A``."""
    return F.regexp_replace(text, _SUFFIX, "$1$2")


def layer_rank(layer: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LAYERS]), layer) - 1


def build_vocabulary(aliases: DataFrame, names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``spelling, kind, code, ord`` from shorthand, full names and nicknames.

    ``aliases(alias, subject)``, ``names(subject, name, ordinal)`` (an earlier
    ordinal wins a shared spelling), ``nicknames(nickname, target)`` where a
    target with a space is a course.
    """
    a = aliases.select(F.col("alias").alias("spelling"), F.lit("alias").alias("kind"), F.col("subject").alias("code"),
                       F.lit(0).alias("ord"))
    spaced = normalise(F.col("name"))
    n = names.select(F.explode(F.array_distinct(F.array(spaced, squash(spaced)))).alias("spelling"),
                     F.lit("name").alias("kind"), F.col("subject").alias("code"), F.col("ordinal").alias("ord"))
    k = nicknames.select(normalise(F.col("nickname")).alias("spelling"),
                         F.when(F.col("target").contains(" "), "nick_course").otherwise("nick_subject").alias("kind"),
                         F.col("target").alias("code"), F.lit(0).alias("ord"))
    rows = a.unionByName(n).unionByName(k).where("spelling <> ''")
    return rows.groupBy("spelling", "kind").agg(F.min_by("code", F.struct("ord", "code")).alias("code"))


def variants(queries: DataFrame, filler: Sequence[str] = FILLER) -> DataFrame:
    """Distinct query texts with their variants in order: as typed, suffix joined,
    filler stripped, both."""
    base = normalise(F.col("query"))
    bare = strip_filler(base, filler)
    step = lambda t, layer, o: F.struct(t.alias("text"), F.lit(layer).alias("step"), F.lit(o).alias("v"))
    made = F.array(step(base, "exact", 0), step(split_suffix(base), "split", 1), step(bare, "filler", 2),
                   step(split_suffix(bare), "split", 3))
    rows = queries.select("query").distinct().select("query", F.inline(made)).where("text <> ''")
    # a text reached twice keeps its first, least forgiving form
    return rows.groupBy("query", "text").agg(F.min_by(F.struct("step", "v"), "v").alias("m")).select(
        "query", "text", "m.step", "m.v")


def _readings(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(subject code, number, layer) readings of each variant in matching order."""
    subject, number = F.regexp_extract("text", _PAIR, 1), F.regexp_extract("text", _PAIR, 2)
    rows = rows.withColumns({"_s": F.trim(subject), "_n": number}).where("_n <> ''")
    rows = rows.withColumns({"_cs": F.trim(F.regexp_extract("_s", _CROSS, 1)), "_cn": F.regexp_extract("_s", _CROSS, 2)})

    def spellings(s: Column, lead: Column, base: int) -> list[Column]:
        tight = squash(s)
        kinds = (("alias", s), ("self", s), ("alias", tight), ("self", tight), ("name", s), ("name", tight),
                 ("nick_subject", s), ("nick_subject", tight))
        return [F.struct(k_col.alias("spelling"), F.lit(kind).alias("kind"), F.lit(base + i).alias("o"),
                         s.alias("s"), tight.alias("tight"), lead.alias("lead")) for i, (kind, k_col) in enumerate(kinds)]

    main = spellings(F.col("_s"), F.lit(""), 0)
    crossed = spellings(F.col("_cs"), F.col("_cn"), 8)
    asked = rows.select("query", "text", "step", "v", "_n", F.inline(F.array(*main, *crossed))).where(
        (F.col("lead") == "") & (F.col("o") < 8) | (F.col("lead") != "") & (F.col("o") >= 8) & (F.col("s") != ""))
    known = vocabulary.where(F.col("kind").isin("alias", "name", "nick_subject"))
    found = asked.join(known, ["spelling", "kind"], "left")
    code = F.when(F.col("kind") == "self", F.col("spelling")).otherwise(F.col("code"))
    self_named = (F.col("code") == F.col("s")) | (F.col("code") == F.col("tight"))
    layer = F.when(F.col("kind") == "self", "exact").when((F.col("kind") == "alias") & self_named, "exact") \
        .when(F.col("kind") == "nick_subject", "nickname").otherwise(F.col("kind"))
    found = found.select("query", "text", "step", "v", "_n", "lead", "o", code.alias("subject"), layer.alias("layer")) \
        .where("subject IS NOT NULL AND subject <> ''")
    first = found.groupBy("query", "text", "step", "v", "_n", "lead", "subject").agg(
        F.min_by(F.struct("layer", "o"), "o").alias("m"))
    numbers = F.when(F.col("lead") == "", F.array("_n", F.concat(F.lit("C"), "_n"))).otherwise(
        F.array(F.concat("lead", "_n"), F.col("_n"), F.concat(F.lit("C"), "_n")))
    return first.select("query", "text", "step", "v", "subject", "m.layer", "m.o",
                        F.posexplode(F.array_distinct(numbers)).alias("k", "number"))


def _best(hits: DataFrame, order: Sequence[str]) -> DataFrame:
    return hits.groupBy("query").agg(
        F.min_by(F.struct("course_key", "step", "filler", "layer"), F.struct(*order)).alias("m")).select("query", "m.*")


def match_courses(queries: DataFrame, index: DataFrame, vocabulary: DataFrame,
                  filler: Sequence[str] = FILLER) -> DataFrame:
    """``query, course_key, layer`` per distinct query; ``miss`` with a null key otherwise.

    ``index`` has ``course_key, subject, number, joins``.
    """
    rows = variants(queries, filler)
    keys = index.select("course_key", "subject", "number", F.coalesce("joins", F.lit(0)).alias("joins"))
    nick = rows.join(vocabulary.where("kind = 'nick_course'").select(
        F.col("spelling").alias("text"), F.col("code").alias("course_key")), "text")
    nick = nick.join(keys.select("course_key"), "course_key", "left_semi").select(
        "query", "step", "v", "course_key", F.lit("nickname").alias("layer"), F.lit(-1).alias("o"), F.lit(0).alias("k"))
    pairs = _readings(rows, vocabulary).withColumn("course_key", F.concat_ws(" ", "subject", "number"))
    pairs = pairs.join(keys.select("course_key"), "course_key", "left_semi").select(
        "query", "step", "v", "course_key", "layer", "o", "k")
    bare = rows.where(F.col("text").rlike(r"^\d+[A-Z]*$")).select(
        "query", "step", "v", F.explode(F.array(F.col("text"), F.concat(F.lit("C"), "text"))).alias("number"))
    top = keys.groupBy("number").agg(F.min_by("course_key", F.struct(-F.col("joins"), F.col("course_key"))).alias("course_key"),
                                     F.max("joins").alias("joins"))
    bare = bare.join(top, "number")
    bare = bare.groupBy("query", "step", "v").agg(
        F.min_by("course_key", F.struct(-F.col("joins"), F.col("course_key"))).alias("course_key")).select(
        "query", "step", "v", "course_key", F.lit("bare").alias("layer"), F.lit(0).alias("o"), F.lit(0).alias("k"))
    exact = _best(nick.unionByName(pairs).unionByName(bare).withColumn("filler", F.col("v") >= 2), ["v", "o", "k"])
    left = rows.join(exact.select("query"), "query", "left_anti")
    near = _fuzzy(left, keys, vocabulary)
    hits = exact.unionByName(near)
    # the most forgiving step on the way names the match
    path = F.greatest(layer_rank(F.col("step")), layer_rank(F.col("layer")),
                      F.when(F.col("filler"), F.lit(LAYERS.index("filler"))).otherwise(0))
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), path.cast("int") + 1)
    return queries.select("query").distinct().join(
        hits.select("query", "course_key", layer.alias("layer")), "query", "left").select(
        "query", "course_key", F.coalesce("layer", F.lit("miss")).alias("layer"))


def subject_spellings(keys: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every squashed spelling of every subject in the index."""
    subjects = keys.select("subject").distinct()
    named = vocabulary.where(F.col("kind").isin("alias", "name", "nick_subject")).select(
        squash(F.col("spelling")).alias("token"), F.col("code").alias("subject"))
    named = named.join(subjects, "subject", "left_semi")
    return subjects.select(F.col("subject").alias("token"), "subject").unionByName(
        named.select("token", "subject")).where("token <> ''").distinct()


def _without(text: Column) -> Column:
    """``text`` less one letter, for each of its letters."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(
        F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def _thinned(rows: DataFrame, word: str) -> DataFrame:
    """Add ``piece`` and ``gone``: the word less up to two letters, and how many."""
    once = F.array_distinct(_without(F.col(word)))
    twice = F.array_distinct(F.flatten(F.transform(F.filter(once, lambda t: t != ""), _without)))
    each = lambda pieces, n: F.transform(pieces, lambda t: F.struct(t.alias("piece"), F.lit(n).alias("gone")))
    return rows.select("*", F.inline(F.concat(F.array(F.struct(F.col(word).alias("piece"), F.lit(0).alias("gone"))),
                                              each(once, 1), each(twice, 2))))


def near_subjects(tokens: DataFrame, keys: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, subject, d, subject_joins`` of the subjects with a spelling one edit from ``token`` (two from six letters
    on), d being the closest one's distance; equal spellings don't count.

    Words at a distance of k share what is left after taking k letters from each. So both sides are written out without
    up to two letters and meet by equality; the distance is measured on pairs that met.
    """
    joins = keys.groupBy("subject").agg(F.sum("joins").alias("subject_joins"))
    spelled = subject_spellings(keys, vocabulary).select(F.col("token").alias("spelling"), "subject")
    limit = F.when(F.length("token") <= 5, 1).otherwise(2)
    asked = _thinned(tokens.select("token").where("token <> ''").distinct().withColumn("limit", limit), "token") \
        .where(F.col("gone") <= F.col("limit")).drop("gone")
    held = _thinned(spelled.select("spelling").distinct(), "spelling")
    met = asked.join(held, "piece").where((F.col("gone") <= F.col("limit")) & (F.col("token") != F.col("spelling"))) \
        .select("token", "spelling", "limit").distinct()
    close = met.withColumn("d", osa_distance("token", "spelling")).where(F.col("d") <= F.col("limit"))
    return close.join(spelled, "spelling").groupBy("token", "subject").agg(F.min("d").alias("d")).join(joins, "subject")


def _fuzzy(rows: DataFrame, keys: DataFrame, vocabulary: DataFrame) -> DataFrame:
    token = squash(F.trim(F.regexp_extract("text", _PAIR, 1)))
    asked = rows.select("query", "step", "v", token.alias("token"), F.regexp_extract("text", _PAIR, 2).alias("_n")) \
        .where("_n <> ''")
    close = asked.join(near_subjects(asked, keys, vocabulary), "token").select(
        "query", "step", "v", "subject", "d", "subject_joins",
        F.posexplode(F.array(F.col("_n"), F.concat(F.lit("C"), "_n"))).alias("k", "number"))
    close = close.join(keys.select("subject", "number", "course_key"), ["subject", "number"])
    close = close.withColumns({"layer": F.lit("fuzzy"), "filler": F.col("v") >= 2, "_j": -F.col("subject_joins")})
    return _best(close, ["v", "d", "_j", "subject", "k"])


def nearest_courses(missed: DataFrame, index: DataFrame, vocabulary: DataFrame, n: int = 3) -> DataFrame:
    """Up to three courses to offer for a miss: the subject's own, else those of the nearest subjects by spelling, else the
    most joined."""
    keys = index.select("course_key", "subject", "number", F.coalesce("joins", F.lit(0)).alias("joins"))
    by_joins = [F.desc("joins"), F.col("course_key")]
    ranked = F.row_number().over(Window.partitionBy("subject").orderBy(*by_joins))
    best = keys.withColumn("rank", ranked).where(F.col("rank") <= n).select("subject", "course_key", "joins", "rank")
    typed = variants(missed).where("v = 0")
    own = _readings(typed, vocabulary).groupBy("query", "subject").agg(F.min("o").alias("o"))
    own = own.join(best, "subject")
    first = own.groupBy("query").agg(F.min("o").alias("o"))
    own = own.join(first, ["query", "o"]).select("query", "rank", "course_key")
    asked = typed.join(own.select("query").distinct(), "query", "left_anti").select(
        "query", squash(F.trim(F.regexp_extract("text", _PAIR, 1))).alias("token")).where("token <> ''")
    close = asked.join(near_subjects(asked, keys, vocabulary), "token").join(best.drop("rank"), "subject")
    order = F.row_number().over(Window.partitionBy("query").orderBy("d", F.desc("subject_joins"), "subject", *by_joins))
    close = close.withColumn("rank", order).where(F.col("rank") <= n).select("query", "rank", "course_key")
    offered = own.unionByName(close)
    top = keys.orderBy(*by_joins).limit(n).select(
        F.lit(1).alias("_one"), "course_key", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by_joins)).alias("rank"))
    rest = missed.select("query").distinct().join(offered.select("query").distinct(), "query", "left_anti")
    rest = rest.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").select("query", "rank", "course_key")  # n rows
    return offered.unionByName(rest)


def match_titles(queries: DataFrame, titles: DataFrame, index: DataFrame, vocabulary: DataFrame,
                 filler: Sequence[str] = FILLER) -> DataFrame:
    """Courses whose title holds every query word, else an instructor whose name does
    (surname among them). Words are matched whole.

    Only the rarest word of a query is joined; the others are checked on the hit.
    """
    base = normalise(F.col("query"))
    words = lambda t: F.filter(F.split(t, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    asked = queries.select("query").distinct().where(~F.col("query").rlike(r"\d"))
    asked = asked.select("query", base.alias("_b"), strip_filler(base, filler).alias("_f")).where(
        (F.length("_b") >= 3) & (F.col("_f") != ""))
    asked = asked.select("query", F.posexplode(F.array(words(F.col("_b")), words(F.col("_f")))).alias("v", "q")).where(
        F.size("q") > 0).withColumn("text", F.array_join("q", " "))
    # a subject on its own is not a title query
    subjects = index.select(F.col("subject").alias("text")).unionByName(
        vocabulary.where(F.col("kind") != "nick_course").select(F.col("spelling").alias("text"))).distinct()
    plain = asked.join(subjects, "text", "left_semi").select("query").distinct()
    asked = asked.join(plain, "query", "left_anti")
    rows = titles.join(index.select("course_key", F.coalesce("joins", F.lit(0)).alias("joins")), "course_key")
    holds = rows.select("course_key", "joins", F.lit(0).alias("where"), F.split(normalise(F.col("title")), " ").alias("held"))
    people = rows.select("course_key", "joins", F.lit(1).alias("where"), F.explode("instructors").alias("_i")).select(
        "course_key", "joins", "where", F.split(normalise(F.col("_i")), " ").alias("held"))
    texts = holds.unionByName(people)
    tokens = texts.withColumn("word", F.explode(F.array_distinct("held"))).where("word <> ''")
    common = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rare = asked.select("query", "v", "q", F.explode("q").alias("word")).join(common, "word", "left")
    rare = rare.groupBy("query", "v").agg(F.first("q").alias("q"), F.min_by("word", F.struct(
        F.coalesce("df", F.lit(0)), F.col("word"))).alias("word"))
    hit = rare.join(tokens, "word").where(F.size(F.array_except("q", "held")) == 0)
    hit = hit.where((F.col("where") == 0) | F.array_contains("q", F.element_at("held", -1)))
    order = F.struct("v", "where", -F.col("joins"), F.col("course_key"))
    return hit.groupBy("query").agg(F.min_by("course_key", order).alias("course_key")).withColumn("layer", F.lit("title"))


def _prefixes(text: Column, shortest: int = 1) -> Column:
    return F.when(F.length(text) >= shortest, F.transform(
        F.sequence(F.lit(shortest), F.length(text)), lambda i: F.substring(text, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def prefix_index(index: DataFrame, n: int = 8) -> DataFrame:
    """What typing meets by equality: for every subject prefix with every number prefix, and for every prefix of a whole
    key, the ``n`` courses that rank first there (``whole``: the prefix is the subject).

    A course stands under a few dozen prefixes. Partial top lists are cut to ``n`` before they are shuffled, so a
    one-letter prefix moves n rows a task, however many courses it has.
    """
    numbers = F.array_distinct(F.concat(_prefixes(F.col("number"), 0), F.when(
        F.col("number").startswith("C"), _prefixes(F.expr("substring(number, 2)"), 1)).otherwise(F.array().cast("array<string>"))))
    rows = index.where(F.length("subject") > 0).select(
        "course_key", "subject", F.coalesce("joins", F.lit(0)).alias("joins"), numbers.alias("_numbers"))
    by_subject = rows.select("course_key", "joins", "subject", "_numbers", F.explode(_prefixes(F.col("subject"))).alias("prefix")) \
        .select("course_key", "joins", F.lit("subject").alias("kind"), "prefix", F.explode("_numbers").alias("number"),
                (F.col("prefix") == F.col("subject")).alias("whole"))
    by_key = rows.select("course_key", "joins", F.lit("key").alias("kind"),
                         F.explode(_prefixes(F.regexp_replace("course_key", r"\s+", ""))).alias("prefix"),
                         F.lit("").alias("number"), F.lit(False).alias("whole"))
    order = F.row_number().over(Window.partitionBy("kind", "prefix", "number").orderBy(
        F.desc("whole"), F.desc("joins"), "course_key"))
    return by_subject.unionByName(by_key).withColumn("rank", order).where(F.col("rank") <= n).drop("rank")


def _typed_subjects(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query and ``code``: every subject code that the typed subject could mean, as column ``subject``."""
    tight = squash(F.col("subject"))
    spelled = asked.select("query", F.explode(F.array_distinct(F.array(F.col("subject"), tight))).alias("spelling")).where("spelling <> ''")
    known = vocabulary.where(F.col("kind").isin("alias", "name", "nick_subject")).select("spelling", "code")
    return spelled.join(known, "spelling").select("query", "code").unionByName(
        spelled.select("query", F.col("spelling").alias("code"))).distinct()


def suggest_courses(queries: DataFrame, index: DataFrame, vocabulary: DataFrame, n: int = 8,
                    prefixes: DataFrame | None = None, filler: Sequence[str] = FILLER) -> DataFrame:
    """Suggestions while typing: the course that the text means, then subjects in whole, then by prefix, most joined first.

    With a number only courses whose number begins so; without one a prefix of the whole key counts too. Where nothing
    begins as typed, what the matcher finds is offered, for a bare number all its courses. ``prefixes`` is a written
    ``prefix_index`` of ``n``.
    """
    prefixes = prefix_index(index, n) if prefixes is None else prefixes
    keys = index.select("course_key", "subject", "number", F.coalesce("joins", F.lit(0)).alias("joins"))
    pair = lambda i: F.regexp_extract("_raw", _PAIR, i)
    asked = queries.select("query").distinct().withColumn("_raw", normalise(F.col("query"))).where("_raw <> ''") \
        .withColumn("number", pair(2))
    asked = asked.withColumn("subject", F.when(F.col("number") != "", F.trim(pair(1))).otherwise(F.col("_raw")))
    crossed = asked.where("number <> ''").select("query", F.trim(F.regexp_extract("subject", _CROSS, 1)).alias("subject"))
    codes = _typed_subjects(asked.select("query", "subject").unionByName(crossed), vocabulary)
    codes = codes.join(asked.select("query", "number"), "query").select("query", F.lit("subject").alias("kind"), F.col("code").alias("prefix"), "number")
    typed = codes.unionByName(asked.where("number = ''").select(
        "query", F.lit("key").alias("kind"), squash(F.col("_raw")).alias("prefix"), "number"))
    score = F.when(F.col("whole"), 2).otherwise(1)
    begun = typed.join(prefixes, ["kind", "prefix", "number"]).select("query", "course_key", "joins", score.alias("score"))
    found = match_courses(queries, index, vocabulary, filler).where("course_key IS NOT NULL")
    meant = found.join(keys, "course_key").withColumnRenamed("number", "_number").join(typed, "query").where(
        F.when(F.col("kind") == "key", F.expr("startswith(regexp_replace(course_key, '\\\\s+', ''), prefix)")).otherwise(
            F.expr("startswith(subject, prefix) AND (startswith(_number, number) OR startswith(_number, concat('C', number)))")))
    meant = meant.select("query", "course_key", "joins", (F.when(
        (F.col("kind") == "subject") & (F.col("subject") == F.col("prefix")), 2).otherwise(1) + 10).alias("score"))
    hits = begun.unionByName(meant)
    left = found.join(hits.select("query").distinct(), "query", "left_anti")
    by_number = Window.partitionBy("_n").orderBy(F.desc("joins"), "course_key")
    plain = lambda c: F.regexp_replace(c, r"^C(?=\d)", "")  # noqa: E731 - a number and its C form go together
    lists = keys.withColumn("_n", plain(F.col("number"))).withColumn("rank", F.row_number().over(by_number)).where(F.col("rank") <= n)
    bare = left.where("layer = 'bare'").join(keys.select("course_key", plain(F.col("number")).alias("_n")), "course_key") \
        .select("query", "_n").join(lists.select("_n", "course_key", "joins"), "_n")
    other = left.where("layer <> 'bare'").join(keys.select("course_key", "joins"), "course_key")
    hits = hits.unionByName(bare.select("query", "course_key", "joins", F.lit(0).alias("score"))) \
        .unionByName(other.select("query", "course_key", "joins", F.lit(0).alias("score")))
    hits = hits.groupBy("query", "course_key").agg(F.max("score").alias("score"), F.max("joins").alias("joins"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("joins"), "course_key"))
    return hits.withColumn("rank", order).where(F.col("rank") <= n).select("query", "rank", "course_key")
