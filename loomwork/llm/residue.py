"""Template residue and error-page text.

Records of one template are aligned by their frames, and the words in which aligned records differ are its slots. A
slot that still holds a variable name, a default or a blank was never filled in:

* A sentence with a placeholder is residue unless the sentence itself writes about the mark: the mark is quoted, is the
  object of a word of notation (writes, printed, the variable ...), is given a value (set ... to) or is called a name.
  Such a sentence is pending: its frame (names, numbers and marks as wildcards) is aligned with the frames of all other
  sentences, and it is residue after all if some record fills or leaves out the slot.
* A sentence with a default (null, undefined, NaN, None) or a blank before a comma or full stop where a word may have
  been is pending as well, in titles too: it is residue if two other sentences of its frame fill that place in two ways
  (with a name or a number; other words would make prose of "a null result" a case). "[object Object]" is a mark.
* A line is a message if it is made of the words of error, blocking and script notices and says that something failed;
  a record is one if all its lines are, whatever their number, or if one line of a longer record is a whole notice
  (``is_notice``). A short page that says of a failure in words of its own is pending: its page template is aligned
  over all records, and one repeated on at least ``LEAST_HOSTS`` hosts is an error template.
* Filler is a line made only of dummy words. A title is judged without its site's name.

More records only add evidence: a verdict never turns back as a table grows. Null and blank texts are no cases;
repeated rows of one id count once.
"""

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans.lineage import cut

SCHEMA = "rec_id bigint, reason string, pending string"
LEAST_HOSTS = 3

NAME = r"[A-Za-z_][A-Za-z0-9_.]*|[A-Z][A-Z]+(?: [A-Z]+)+|[Ii][Nn][Ss][Ee][Rr][Tt] [A-Za-z ]{1,30} [Hh][Ee][Rr][Ee]"
MARK = re.compile(
    rf"\{{\{{ ?(?:{NAME}) ?\}}\}}|\{{% ?(?:{NAME}) ?%\}}|<%=? ?(?:{NAME}) ?%>|<<(?:{NAME})>>|%\((?:{NAME})\)[sS]|%%(?:{NAME})%%|@@(?:{NAME})@@|\[\[(?:{NAME})\]\]"
    rf"|\$\{{(?:{NAME})\}}|\$(?:{NAME})\$|\{{(?:{NAME})\}}|\[(?:{NAME})\]|\[object Object\]",
)
MARK_HINT = re.compile(r"\{[{%A-Za-z_ ]|<%|<<|%\(|%%|@@|\[[\[A-Za-z_]|\$[A-Za-z_{]")
#: What shows a sentence to be about its mark (written as \0 here), fixed values.
ABOUT = re.compile(
    r"\b(?:writes?|wrote|written|prints?|printed|types|typed|sign read)(?: (?:out|only|just|literally|as|a|an|the))* \0"
    r"|\b(?:variables?|placeholders?|syntax)(?: (?:called|named|like|such as|is|of|for))? \0|\0(?: is| as|,)? (?:a|an|the|its) (?:\w+ )?(?:variable|placeholder|syntax)\b"
    r"|\b(?:set|export|unset|define) (?:the )?\0(?: to\b| ?=)|\0 as (?:a|an|the|its|their) (?:name|symbol|spelling)\b",
    re.I,
)
#: Places that hold a default or a blank, and what comes before a sentence that may begin with one (\0).
EMPTY_SIGNS = ("null", "NULL", "Null", "undefined", "NaN", "nan", "None", " ,", " .", "\t,", "\t.", "\u00a0,", "\u00a0.")
EMPTY = re.compile(r"(?<![\w\"“'`.\-/])(?:null|NULL|Null|undefined|NaN|nan|None(?! of\b))(?![\w\"”'`\-/=(\[])|(?<=\w) (?=[,.](?:\s|$))")
EMPTY_END = re.compile(r"[.!?][\"”)]*\s+(?=[\"“(\[]?(?:[^\W\d_a-zà-ÿ]|\0))")
QUOTED = re.compile(r"(?:^|[\s(\[])[\"“][^\"“”]*$")
SENTENCE_END = re.compile(r"[.!?][\"”)]*\s+(?=[\"“(\[]?[^\W\d_a-zà-ÿ])")

# Dummy words, and messages as runs of lower-case words with digits as 9.
LATIN = set("""lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam
quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla
pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vulputate morbi erat vestibulum
pellentesque habitant tristique senectus netus malesuada fames ac turpis egestas integer nunc mauris vitae augue faucibus ornare viverra""".split())
LATIN_ONLY = LATIN - set("in do ad non est et id sed ex ea ut sit quis qui a ac eu erat integer sint sunt nulla minim magna".split())
DUMMY = set("text sample dummy test foo bar baz qux blah xxx copy content more some here goes your insert description tbd tbc todo asdf qwer placeholder paragraph filler title words word".split())
DUMMY_ONLY = set("dummy foo baz qux blah xxx tbd tbc asdf qwer placeholder filler".split())
DEFAULTS = set("null undefined none nan object".split())
PREFIX = "error http status problem oops sorry fehler erreur warning".split()
CORES = """bad request|unauthorised|unauthorized|forbidden|page not found|not found|resource gone|gone|internal server error|server error|bad gateway|service unavailable
service temporarily unavailable|gateway timeout|request timeout|the server took too long to answer|upstream connect failure|we are down for maintenance|too many requests|access denied""".replace("\n", "|").split("|")
ADVICE = """try again later|please try again later|incident logged|go back to the front page|the request could not be satisfied|return to search|contact the site owner if this persists
please try again in 9 seconds|nginy 9 9|nginx 9 9|nginx|request id 9|if nothing happens check that your browser allows scripts|loading|just a moment|please wait""".replace("\n", "|").split("|")
MESSAGES = """active javascript pour continuer|veuillez activer javascript pour continuer|this site requires javascript reload once it is switched on
you need to turn on scripts in your browser to run this app|bitte aktivieren sie javascript um fortzufahren|your browser is not supported upgrade it and allow scripts to continue
please enable javascript to view this page|please enable javascript to continue|javascript is disabled|javascript required|por favor active javascript para continuar
seite nicht gefunden bitte prüfen sie die adresse|seite nicht gefunden|checking your connection before you continue|fatal cannot connect to database on socket 9
your session has expired please sign in again|traceback most recent call last|file render py line 9 in build|keyerror body|page introuvable erreur 9|página no encontrada vuelva al inicio
please confirm that you are human by completing the puzzle|this listing is no longer available|an unexpected problem occurred while handling your request code 9
error 9 access to this resource is forbidden|gateway timeout while waiting for the origin server|too many requests slow down and retry later|access denied your address has been blocked ref 9
we could not find the page you asked for it may have been moved or removed|sample text goes here|placeholder paragraph 9 replace before launch|insert copy insert copy insert copy
your description here your description here|your text here|insert text here""".replace("\n", "|").split("|")
FILLER = {"sample text goes here", "placeholder paragraph 9 replace before launch", "your text here", "insert text here"}
TITLES = """your title here|9 not found|javascript required|attention required|loading|just a moment|untitled document|untitled|untitled page|new page|new document|document|error|lorem ipsum dolor
server error 9|access denied|page not found|seite nicht gefunden|page introuvable|página no encontrada|null|undefined|none|object object|title|page title|insert title|default title|home page title""".replace("\n", "|").split("|")

#: Words that messages are made of, and what says that something failed, fixed values.
MESSAGE_WORDS = set("""9 a about again all an and any app are as at be because been before but by can cannot check click code connection content cookies could couldn d denied disabled does doesn don
enable error exist exists expired failed file find for found from go has have here home http if in internet is isn it its java javascript later link load loaded longer m may maybe missing moment moved must
my need no not now occurred of off on oops or our page please problem reach refresh reload removed request required resource s scripts server service side sign site something sorry support t temporarily
that the there this to try turn unavailable unexpected url use using valid ve view visit was wait we website went were what while will with wrong you your
cette désolé désolés est existe la le les n nous page sommes plus pas trouvée introuvable erreur veuillez réessayer tard die das der diese seite nicht leider ist wurde wurden gefunden existiert mehr fehler bitte später versuchen erneut es sie
esta la el no página existe encontrada lo sentimos inténtelo más tarde ya""".split())
FAULT = re.compile(
    r"\b(?:not (?:be )?found|can ?not be (?:found|reached|displayed|shown|loaded)|(?:can|couldn|could) ?(?:t|not) (?:be )?(?:find|found|reach|reached|load|loaded|displayed|shown|connect)|does(?:n t| not) exist|no longer (?:exists?|available|here)|went wrong"
    r"|unavailable|denied|expired|failed|(?:enable|turn on|need|requires?) (?:java ?script|scripts|cookies)|(?:javascript|scripts|cookies) (?:is|are|must be) (?:disabled|required|off|missing|enabled)|error (?:has )?occurred|nicht gefunden|existiert nicht"
    r"|nicht mehr|introuvable|n existe (?:plus|pas)|pas trouvée|no existe|no encontrada|ya no)\b"
)
FAILS = re.compile(r"\b(?:error|fail(?:s|ed|ure)?|wrong|sorry|oops|problem|unavailable|denied|blocked|expired|broken|down|missing|found|scripts?|javascript|browser|désolée?s?|erreur|fehler|leider|sentimos)\b")

_CORE = "|".join(re.escape(x) for x in sorted(CORES, key=len, reverse=True))
_PRE = "|".join(PREFIX)
ERROR_LINE = re.compile(rf"(?:(?:{_PRE}) )?(?:9 )?(?:{_CORE})(?: 9)?|(?:{_PRE}) 9|9 (?:{_CORE})")
TAIL = re.compile(r" viewed 9 times$")


def words_of(line: str) -> str:
    """A line as lower-case words, runs of digits as 9."""
    flat = unicodedata.normalize("NFKC", line).lower()
    return re.sub(r"\d+(?: \d+)*", "9", re.sub(r"[^\w]+|_", " ", flat)).strip()


SAID = {words_of(x) for x in (*MESSAGES, *ADVICE)}
#: Messages that are whole sentences of their own; the shorter ones may be a heading of any page.
NOTICES = {words_of(x) for x in MESSAGES if len(words_of(x).split()) >= 4} - {words_of(x) for x in FILLER}
TITLE_SET = {words_of(x) for x in TITLES}


def is_message(line: str) -> bool:
    w = TAIL.sub("", words_of(line))
    return w in SAID or bool(ERROR_LINE.fullmatch(w)) or len(w) < 300 and bool(FAULT.search(w)) and MESSAGE_WORDS.issuperset(w.split(" "))


def is_message_page(lines: list[str]) -> bool:
    """Whether lines say together, and say nothing else than, that a page could not be shown."""
    failed = False
    for line in lines:
        own = is_message(line)
        if not own and not is_filler(line) and not MESSAGE_WORDS.issuperset(TAIL.sub("", words_of(line)).split(" ")):
            return False
        failed = failed or own or is_filler(line)
    return failed


def is_filler(line: str) -> bool:
    """Whether a line consists of dummy words only."""
    w = TAIL.sub("", words_of(line))
    if w in FILLER:
        return True
    parts = [x for x in w.split(" ") if x and x != "9"]
    if len(parts) < 3:
        return False
    if sum(x in LATIN for x in parts) >= 0.9 * len(parts) and len({x for x in parts if x in LATIN_ONLY}) >= min(2, len(set(parts))):
        return True
    if all(x in DEFAULTS for x in parts):
        return True
    known = sum(x in DUMMY for x in parts)
    if known < 0.95 * len(parts):
        return False
    return any(x in DUMMY_ONLY for x in parts) or len(set(parts)) <= max(1, len(parts) // 2)


FILLER_HINT = re.compile(r"\b(?:lorem|ipsum|dolore?|amet|labore|vulputate|tempor|nostrud|aliqua|veniam|consectetur|blah|xxx|qux|foo|baz|tbd|asdf|dummy|undefined|null|insert|placeholder|sample|text|copy)\b", re.I)


def is_notice(line: str) -> bool:
    """Whether a line says as a whole, by itself, that the page could not be shown."""
    w = TAIL.sub("", words_of(line))
    if w in NOTICES:
        return True
    return bool(ERROR_LINE.fullmatch(w)) and "9" in w.split() and len(w.split()) >= 3


def marked(text: str) -> Iterator[tuple[str, bool]]:
    """(sentence with its marks as \\0, whether it writes about each of them) of every sentence with placeholder-like marks."""
    for line in text.split("\n"):
        if not MARK_HINT.search(line):
            continue
        line = re.sub(r"[ \t\u00a0]+", " ", line)
        if not MARK.search(line):
            continue
        # Marks are taken out before sentences are told apart, since names hold dots.
        flat = MARK.sub("\0", line.replace("\0", " "))
        ends = [0, *(m.end() for m in SENTENCE_END.finditer(flat)), len(flat)]
        for begin, end in itertools.pairwise(ends):
            sentence = flat[begin:end]
            if "\0" in sentence:
                about = {m.start() + m.group().index("\0") for m in ABOUT.finditer(sentence)}
                yield sentence.strip(), all(m.start() in about or QUOTED.search(sentence[: m.start()]) for m in re.finditer("\0", sentence))


def has_mark(text: str) -> bool:
    """Whether a placeholder-like mark stands in a sentence that is not about it."""
    return any(not about for _, about in marked(text))


def judge(text: str | None) -> str | None:
    """Why a page text is residue by itself, or None."""
    if not text:
        return None
    lines = [x for x in text.split("\n") if x.strip()]
    if lines and is_message_page(lines):
        return "message"
    if FILLER_HINT.search(text) and any(is_filler(x) for x in lines):
        return "filler"
    if re.fullmatch(r"\s*\[object\s+object\]\s*!?\s*(?:viewed \d+ times)?\s*", text, re.I):
        return "default"
    if any(len(x) < 200 and is_notice(x) for x in lines):
        return "message"
    return "slot" if MARK_HINT.search(text) and has_mark(text) else None


def frame(sentence: str) -> str:
    """A sentence with numbers and capitalised words as wildcards; marks are left out."""
    return re.sub(r"\s+", " ", re.sub(r"[^\W\d_a-zà-ÿ]\w*|\d+", "N", sentence.replace("\0", " "))).strip(" .!?")


def unfilled(text: str) -> Iterator[str]:
    """The frames of sentences with a default or a blank in place of a word, that place as a wildcard."""
    for line in text.split("\n"):
        if not any(x in line for x in EMPTY_SIGNS):
            continue
        line = re.sub(r"[ \t\u00a0]+", " ", line.replace("\0", " "))
        flat = EMPTY.sub(lambda m: " \0" if m.group() == " " else "\0", line)
        ends = [0, *(m.end() for m in EMPTY_END.finditer(flat)), len(flat)]
        for begin, end in itertools.pairwise(ends):
            sentence = flat[begin:end].strip()
            if "\0" not in sentence or ABOUT.search(sentence) or any(QUOTED.search(sentence[: m.start()]) for m in re.finditer("\0", sentence)):
                continue
            own = frame(sentence.replace("\0", "N"))
            if sum(w[0].islower() for w in own.split(" ") if w) >= 2:
                yield own


def page_template(text: str) -> str | None:
    """The template of a short page that speaks of a failure, else None. Names and numbers are wildcards."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines or max(map(len, lines)) > 300 or len(text) > 1000 or not all(FAILS.search(words_of(x)) or len(words_of(x).split()) <= 4 for x in lines) or not FAILS.search(words_of(text)):
        return None
    return re.sub(r"\s+", " ", re.sub(r"\d+", "9", text.lower())).strip()


def pending(text: str | None, title: bool = False) -> Iterator[tuple[str, str]]:
    """(what, evidence that other records may have) of a text that is no residue by itself."""
    if text and any(x in text for x in EMPTY_SIGNS):
        yield from (("default?", x) for x in {*unfilled(text)})
    if text and not title:
        if MARK_HINT.search(text):
            for sentence, about in marked(text):
                if about:
                    yield from (("slot?", x) for x in {frame(sentence), frame(sentence.replace("\0", "N"))})
        own = page_template(text)
        if own:
            yield "page?", own


def judge_title(title: str | None, host: str) -> Iterator[str]:
    """The reason why a title is residue, if it is."""
    if not title or not title.strip():
        return
    bare = title.strip()
    if host:
        bare = re.sub(rf"\s*[\[(]?(?:www\.)?{re.escape(host)}[\])]?\s*", " ", bare, flags=re.I)
    bare = bare.strip(" -|–—:·")
    if bare != title.strip() and not bare:
        return
    w = words_of(bare)
    if w in TITLE_SET or is_filler(bare) or is_message(bare):
        yield "title"
    elif MARK_HINT.search(title) and has_mark(title):
        yield "slot"


def _rows(df: DataFrame, title: bool) -> DataFrame:
    """(rec_id, reason, pending) of ``df``: (rec_id, text, host); ``pending`` is what other records have to show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hosts = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for i, t, host in zip(ids, texts, hosts, strict=True):
                reason = next(judge_title(t, host or ""), None) if title else judge(t)
                if reason:
                    out.append((i, reason, None))
                else:
                    out.extend((i, what, f"{host or i}\t{x}" if what == "page?" else x) for what, x in pending(t, title))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], names=["rec_id", "reason", "pending"])

    return df.mapInArrow(run, SCHEMA)


def _frames(texts: DataFrame) -> DataFrame:
    """(pending, own): the frames of the sentences without marks, what ``frame`` does by built-in functions, and what tells the sentences of one frame apart, null where a default stands."""
    lines = texts.select(F.explode(F.split(F.regexp_replace("text", r"[ \t\x{a0}]+", " "), r"\n|(?<=[.!?])[\"”)]* +(?=[\"“(\[]?[\p{Lu}\d])")).alias("s")).filter("length(s) > 12")
    masked = F.regexp_replace(F.regexp_replace("s", r"(?<![\p{L}\p{N}_])\p{Lu}[\p{L}\p{N}_]*|\d+", "N"), r"\s+", " ")
    defaults = F.col("s").contains("N") & F.col("s").rlike(r"\b(?:NULL|Null|NaN|None)\b")
    return lines.select(F.btrim(masked, F.lit(" .!?")).alias("pending"), F.when(~defaults, F.xxhash64(F.btrim("s", F.lit(" .!?")))).alias("own"))


def residue(pages: dict[str, DataFrame]) -> DataFrame:
    """(src_table, rec_id, reason) for tables given as src_table -> (rec_id, text, host); of ``page_data`` the text is a title."""
    pages = {name: df.filter("rec_id is not null and text is not null") for name, df in pages.items()}
    rows = cut(reduce(DataFrame.unionByName, [_rows(df.select("rec_id", "text", "host"), name == "page_data").withColumn("src_table", F.lit(name)) for name, df in pages.items()]))
    sure = rows.filter("pending is null").select("src_table", "rec_id", "reason")
    asked = rows.filter("reason in ('slot?', 'default?')")
    wanted = asked.select("pending").distinct()
    texts = reduce(DataFrame.unionByName, [df.select("text") for df in pages.values()])
    filled = _frames(texts).join(wanted, "pending", "left_semi").groupBy("pending").agg((F.min("own") < F.max("own")).alias("varies"))
    slots = asked.join(filled, "pending").filter("reason = 'slot?' or varies").select("src_table", "rec_id", F.rtrim("reason", F.lit("?")).alias("reason"))
    short = rows.filter("reason = 'page?'").select("src_table", "rec_id", F.substring_index("pending", "\t", 1).alias("host"), F.expr("substring(pending, instr(pending, '\t') + 1)").alias("page"))
    templates = short.groupBy("page", "host").agg(F.lit(1).alias("one")).groupBy("page").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_HOSTS).select("page")
    repeated = short.join(templates, "page", "left_semi").select("src_table", "rec_id", F.lit("message").alias("reason"))
    return sure.unionByName(slots).unionByName(repeated).distinct()


def sources(scraped: DataFrame, brokers: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    host = lambda url: F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#:]*)", 1), r"^www\.", "").alias("host")
    return {
        "scraped_content": scraped.select(F.col("content_id").cast("bigint").alias("rec_id"), F.col("content").alias("text"), host("url")),
        "broker_results": brokers.select(F.col("result_id").cast("bigint").alias("rec_id"), F.col("full_text").alias("text"), host("detail_url")),
        "page_data": pages.select(F.col("page_id").cast("bigint").alias("rec_id"), F.col("title").alias("text"), host("url")),
    }


def found(scraped: DataFrame, brokers: DataFrame, pages: DataFrame) -> DataFrame:
    """(src_table, rec_id) of every record to be excluded."""
    return residue(sources(scraped, brokers, pages)).select("src_table", "rec_id").distinct()
