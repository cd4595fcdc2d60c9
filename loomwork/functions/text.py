"""Text functions: Column in, Column out. Null in gives null out unless a docstring says otherwise."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\x{00A0}]+"
# Words too common to tell texts apart, and lexicons of tone.
STOP_WORDS = "a an and are as at be by for from has have he her his in is it its of on or she that the their they this to was were will with".split()
POSITIVE = "good great excellent best love happy bright sunny generous careful modest quiet solid sturdy tidy approved easier safe".split()
NEGATIVE = "bad poor worst hate sad broken worn cramped noisy damp dusty hollow rejected cancelled failed delayed crooked".split()


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _parts(c: Column) -> Column:
    return F.struct(c.alias("c"), words(c).alias("w"), sentences(c).alias("s"))


def clean_whitespace(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def remove_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", "")


def straight_quotes(c: Column) -> Column:
    """Typographic quotes and dashes as plain ones; a long dash becomes two hyphens."""
    return F.replace(F.translate(c, "‘’“”–", "''\"\"-"), F.lit("—"), F.lit("--"))


def strip_tags(c: Column) -> Column:
    return clean_whitespace(F.regexp_replace(c, r"<[^>]*>", " "))


def search_term(c: Column) -> Column:
    """Lower case, only letters, digits and blanks, stop words left out."""
    words = F.split(clean_whitespace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), " ")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def sentences(c: Column) -> Column:
    """The parts between runs of '.', '!' and '?', trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[.!?]+", -1), clean_whitespace), lambda s: s != "")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")


def truncate_sentences(c: Column, max_tokens: int) -> Column:
    """Whole sentences from the start as long as their token estimates sum to at most ``max_tokens``."""
    start = F.struct(F.lit("").alias("t"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("on"))

    def step(a: Column, s: Column) -> Column:
        n = a["n"] + token_estimate(s) + 1
        fits = a["on"] & (n <= max_tokens)
        return F.struct(F.when(fits, F.concat(a["t"], F.when(a["t"] == "", "").otherwise(" "), s, F.lit("."))).otherwise(a["t"]).alias("t"), n.alias("n"), fits.alias("on"))

    return F.aggregate(sentences(c), start, step, lambda a: a["t"])


def syllables(word: Column) -> Column:
    """Vowel groups, a silent final e not counted, at least one."""
    groups = F.size(F.regexp_extract_all(word, F.lit("([aeiouy]+)")))
    return F.greatest(F.lit(1), groups - F.when(word.rlike("[^aeiouy]e$"), 1).otherwise(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def text_stats(c: Column) -> Column:
    """STRUCT of counts and averages."""

    def stats(x: Column) -> Column:
        n, k = F.size(x["w"]), F.size(x["s"])
        return F.struct(
            n.alias("n_words"), F.size(F.array_distinct(x["w"])).alias("n_unique"), k.alias("n_sentences"),
            F.when(n > 0, _sum(F.transform(x["w"], F.length)) / n).alias("avg_word_length"), F.when(k > 0, n / k).alias("avg_sentence_length"))

    return let(_parts(c), stats)


_CONSONANT = r"[\p{L}\p{N}&&[^aeiouy]]"


def _counts(c: Column) -> Column:
    """STRUCT of a text and its numbers of words, sentences and syllables (see ``syllables``), counted on the text itself."""
    n_words = lambda x: F.regexp_count(x, F.lit(r"[\p{L}\p{N}]+"))
    n_sentences = F.regexp_count(c, F.lit(r"[^.!?\s\x{00A0}][^.!?]*"))
    # Vowel groups, less silent e's, plus one for each word that would be left without any.
    n_syllables = lambda x: F.regexp_count(x, F.lit("[aeiouy]+")) - F.regexp_count(x, F.lit(rf"{_CONSONANT}e(?![\p{{L}}\p{{N}}])")) + F.regexp_count(x, F.lit(rf"(?<![\p{{L}}\p{{N}}]){_CONSONANT}+e?(?![\p{{L}}\p{{N}}])"))
    return let(F.lower(c), lambda x: F.struct(c.alias("c"), x.alias("low"), n_words(x).alias("nw"), n_sentences.alias("ns"), n_syllables(x).alias("ny")))


def _flesch(x: Column) -> Column:
    n = x["nw"]
    return F.when(n > 0, F.lit(206.835) - F.lit(1.015) * n / F.greatest(F.lit(1), x["ns"]) - F.lit(84.6) * x["ny"] / n)


def flesch(c: Column) -> Column:
    """206.835 - 1.015 words per sentence - 84.6 syllables per word; null for a text without words."""
    return let(_counts(c), _flesch)


def readability_approx(c: Column) -> Column:
    """1 for sentences of 17 words on average, less by a thirtieth for each word more or less, at least 0."""
    return let(_counts(c), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(x["nw"] / F.greatest(F.lit(1), x["ns"]) - 17) / 30)))


def sentiment(c: Column) -> Column:
    """'positive' or 'negative' by a margin of more than two lexicon words, else 'neutral'; short texts are neutral."""
    margin = let(words(c), lambda w: F.size(F.filter(w, lambda x: x.isin(POSITIVE))) - F.size(F.filter(w, lambda x: x.isin(NEGATIVE))))
    tone = let(margin, lambda m: F.when(m > 2, "positive").when(m < -2, "negative").otherwise("neutral"))
    return F.when(c.isNull(), None).when(F.length(c) < 50, "neutral").otherwise(tone)


def jaccard(a: Column, b: Column) -> Column:
    """Of the word sets; 0 when both are empty."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0.0))


def quality(c: Column) -> Column:
    """STRUCT of part scores in 0..1 and their weighted total: length, structure, informativeness, readability."""

    def parts(x: Column) -> Column:
        n = F.length(x["c"])
        length = F.when(n < 50, 0.1).when(n < 200, 0.5).when(n < 500, 0.7).when(n < 2000, 1.0).when(n < 5000, 0.8).otherwise(0.6)
        structure = F.when(F.contains(x["c"], F.lit("\n\n")), 0.3).otherwise(0.0) + F.when(x["ns"] > 2, 0.4).otherwise(0.0) + F.when(x["c"].rlike("[A-Z]"), 0.3).otherwise(0.0)
        digits = F.regexp_count(x["c"], F.lit("[0-9]")) / F.greatest(F.lit(1), n)
        informative = F.when(x["nw"] > 0, 0.7 * F.size(F.array_distinct(F.regexp_extract_all(x["low"], F.lit(r"[\p{L}\p{N}]+"), 0))) / x["nw"]).otherwise(0.0) + 0.3 * F.least(5 * digits, F.lit(1.0))
        readable = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), _flesch(x) / 100)), F.lit(0.0))
        return F.struct(n.alias("n"), length.alias("length_score"), structure.alias("structure_score"), informative.alias("informativeness"), readable.alias("readability"))

    def total(p: Column) -> Column:
        score = F.when(p["n"] < 10, 0.0).otherwise(0.25 * p["length_score"] + 0.25 * p["structure_score"] + 0.25 * p["informativeness"] + 0.25 * p["readability"])
        return F.struct(*[p[x].alias(x) for x in ("length_score", "structure_score", "informativeness", "readability")], F.when(p["n"].isNotNull(), score).alias("quality"))

    return let(let(_counts(c), parts), total)
