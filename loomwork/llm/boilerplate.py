"""Main bodies of pages by a tree-structured graphical model with sum-product inference.

The pages are texts without markup, so the tree is read off the text: the page is the root, each line's zone node hangs
below the zone node of the line before it, and each zone node has the line's observed form as a leaf. Zones are top
(notices, menu, breadcrumbs), body, inset (prompts and marks amid the body), lead (the heading of a list of links), side (its link headlines) and foot.
Parent-child potentials connect zones, zone-form potentials the leaves. Messages pass upward and downward once; the
marginals say for each line how likely it lies in the body. All pages of a batch are computed at once.

A line's form is what it looks like by itself (``form_of``): its number of words, its last mark, leading dashes and bars
between its parts give prose, item, headline, point and short label; cues of notices, prompts, bylines, legal lines and
footers in four languages give forms of their own. No form alone decides: a headline or a short label is body where its
neighbours are, and so is a line that only speaks of cookies; a link headline is told by the lead above it or by
standing among others with no text below.

The potentials are trained on labelled pages: the lines of a bounded sample of pages (``max_pages`` pages of less than
``max_chars`` characters, chosen by a seeded hash) whose form settles their zone are the labels, the other lines count
with their expected zones; the sample is the only thing that reaches the driver. Prior counts keep rare transitions
possible.

Lines are split at '\\n' and numbered from 1; blank lines are numbered but never reported. Null and blank texts and
records that consist only of an error, script or filler message have no rows. Repeated rows of one id count once.
"""

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.residue import is_filler, is_message_page, words_of

MAX_PAGES = 1500
SEED = 11
ZONES = ("top", "body", "inset", "lead", "side", "foot")
FORMS = ("title", "headline", "prose", "item", "short", "bar", "crumb", "cookie", "byline", "prompt", "ad", "lead", "legal", "foot", "point")
TOP, BODY, INSET, HEADING, SIDE, FOOT = range(6)
T, H, P, I, S, BAR, CRUMB, COOKIE, BY, PROMPT, AD, LEAD, LEGAL, END, POINT = range(15)

# Standing phrases, tried in this order against a line in lower case with plain blanks and digits as 9.
PHRASES = [
    (LEAD, r"(?:readers also (?:viewed|liked|read)|also (?:viewed|liked|read)|you may also like|more from this section|trending now|related(?: stories| articles)?|most read|popular now|read next|recommended(?: for you)?|see also|more stories|around the web|mehr zum thema|meistgelesen|empfohlen|relacionado|recomendados?|à voir aussi|das könnte sie auch interessieren|auch interessant"
           r"|vous aimerez aussi|à lire aussi|les plus lus|sur le même sujet|también te puede gustar|lo más leído|más noticias|te puede interesar|weitere artikel)"),
    (AD, r"(?:advertisement|advertising|ad|sponsored(?: content)?|anzeige|werbung|publicité|publicidad|anuncio|paid partnership|promoted)"),
    (BY, r"by (?!browsing)[\w' -]+(?:, staff writer| desk)?|by the [\w' -]+ desk|words and pictures: .+|reporting by .+; editing by .+|par [\w' -]+(?:, rédaction de .+)?|por [\w' -]+(?:, redacción de .+)?|von [\w' -]+, .+|von [\w' -]+"
         r"|text(?:e|o)? ?: [\w' -]+|contributed by members .+|tested by .+ panel|photographs? by .+|[\w-]+ by members of the .+ panel"),
    (PROMPT, r"enjoying this\? .+|.*\bsign up for our .+ letter|share this page: .+|share this .+|save this item to read later|tell a friend about .+|follow .+ for more stories like this|(?:have|got|send) a tip\? .+|listen to this page in .+ app"
             r"|support local reporting .+|join 9 other readers.*|get .+ alerts .+|rate this .+|.+ comments so far - join in|like us\? .+|send to a friend via .+|was this page helpful\? .+|apoya a .+|abonnez-vous .+|recommander .+ à un ami"
             r"|suscríbete al boletín .+|recomienda .+ a un amigo|avisos de .+ en tu móvil|alertes .+ sur mobile|artikel teilen: .+|partager ?: .+|compartir: .+|jetzt den newsletter .+|empfehlen sie .+ weiter|soutenez .+|unterstützen sie .+"
             r"|kostenlos: der .+ brief|[\w' -]+-alarm .+|.+ aufs handy|recevez .+|recibe .+|votre avis .+|hinweise an die redaktion .+|gratis: .+|gratuit ?: .+|.* to your (?:wall|feed)"),
    (LEGAL, r"listings courtesy of .+|.+ is a trading name of .+|licensed in .+ and .+|information on this page is supplied by third parties.*|.*\bequal opportunity in housing.*|.*editor'?s'? note ?: prices and times were right.*"
            r"|prices, sizes and distances are approximate.*|prices sizes and distances are approximate.*|we may earn a small commission.*|reviews on .+ are written by testers.*|correction requests go to .+|this story is part of our .+ series.*"
            r"|quotes delayed\.? not advice.*|privacy choices for residents of .+|.+ pertenece al grupo .+|données sans garantie.*|datos sin garantía.*|alle angaben ohne gewähr.*|.+ est édité par .+|ein angebot der .+|printed and hosted by .+"
            r"|complaints ?: .+|part of the .+ group|.*reproduction without written consent.*|.*not be relied upon without an independent check.*"),
    (END, r"(?:\(c\)|©|copyright) ?9?.*|.*\b(?:all rights reserved|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados).*|back to top|nach oben|haut de page|volver arriba|terms of use \|? ?.*|sitemap - .+|press [-–] partners.*"
          r"|impressum ?\|.*|aviso legal ?\|.*|mentions légales ?\|.*|open \w+ to \w+,? phone .+|telefon .+ geschlossen|tél(?:éphone)?\.? .+ fermé.*|teléfono .+ cerrado.*|.*\bphone 9-9.*|terms of use .*privacy.*"),
    (COOKIE, r"cookie|tracking\.|trackers|\bconsent\b|consentement|small text files|small files|strictly necessary|advertising firms|remember our settings|kleine dateien|petits fichiers|pequeños archivos"
             r"|privatsphäre ist uns wichtig|vie privée compte|valoramos su privacidad|privacy matters|measure our audience|partners store information"),
]
COMPILED = [(k, re.compile(p if k == COOKIE else rf"(?:{p})(?: viewed 9 times)?")) for k, p in PHRASES]
#: Words of a line without a full stop that may be a headline; shorter ones are labels, longer ones prose.
LEAST_HEADLINE, MOST_HEADLINE = 5, 12


def flat(line: str) -> str:
    """A line with plain blanks, in lower case, digits as 9, without a mark added at its end."""
    if "&" in line:
        line = html.unescape(line)
    out = re.sub(r"[\s\u00a0]+", " ", unicodedata.normalize("NFKC", line)).strip().lower()
    out = re.sub(r"\d+", "9", out).replace("’", "'").replace(" :", ":")
    return re.sub(r"(?: !)?(?: viewed 9 times)?$", "", out)


def form_of(line: str) -> int:
    """The form of a line that is not blank, without regard to its place."""
    low = flat(line)
    bare = re.sub(r"^[*•·–—-] ?", "", low).strip()
    plain = bare.rstrip(".! ")
    words = plain.count(" ") + 1
    dash = low[:1] == "-"
    if words >= 9 and len(plain) > 150 and "|" not in plain and not COMPILED[-1][1].search(plain):
        if not COMPILED[4][1].fullmatch(plain):
            return I if dash else P
    for kind, pattern in COMPILED:
        if (pattern.search(plain) if kind == COOKIE else pattern.fullmatch(plain)) and not (kind == COOKIE and words > 40):
            return kind
    if plain.count(" | ") >= 2 or low.count("|") >= 2:
        return BAR
    if " > " in plain and plain.count(" > ") >= 2:
        return CRUMB
    if dash:
        return I if words >= 5 else POINT
    if bare[-1:] in ".!?…" and words >= 6 or words > MOST_HEADLINE:
        return P
    return H if words >= LEAST_HEADLINE else S


# ---- the model ---------------------------------------------------------------------------------------------------

N_ZONES, N_FORMS = len(ZONES), len(FORMS)
#: Forms that settle the zone of a labelled line by themselves.
SETTLED = {P: BODY, I: BODY, CRUMB: TOP, PROMPT: INSET, AD: INSET, BY: INSET, LEAD: HEADING}
#: Prior counts of zone -> zone and zone -> form; they keep what the sample never shows possible but rare.
STEPS = np.array([
    [60.0, 30.0, 8.0, 0.05, 0.01, 0.2],
    [0.001, 60.0, 25.0, 8.0, 0.02, 8.0],
    [0.3, 40.0, 20.0, 4.0, 0.02, 8.0],
    [0.01, 0.1, 0.3, 0.1, 60.0, 0.3],
    [0.01, 0.1, 0.3, 0.3, 60.0, 25.0],
    [0.01, 0.05, 0.3, 1.0, 0.02, 60.0],
])
START = np.array([60.0, 30.0, 5.0, 0.05, 0.02, 3.0])
SHOWN = np.full((N_ZONES, N_FORMS), 0.02)
for _zone, _forms in (
    (TOP, {S: 60, POINT: 10, BAR: 20, CRUMB: 20, COOKIE: 20, AD: 1, PROMPT: 1}),
    (BODY, {T: 20, H: 20, P: 60, I: 20, S: 3, POINT: 8, COOKIE: 1}),
    (INSET, {BY: 30, PROMPT: 30, AD: 20, COOKIE: 0.3}),
    (HEADING, {LEAD: 60, S: 4, H: 0.05}),
    (SIDE, {H: 60, T: 1, S: 1, POINT: 3}),
    (FOOT, {LEGAL: 40, END: 40, BAR: 5, S: 3, POINT: 1, PROMPT: 8, AD: 2, COOKIE: 2}),
):
    for _form, _count in _forms.items():
        SHOWN[_zone, _form] += _count
#: Zones in which a line of this form is body.
KEPT = np.zeros((N_ZONES, N_FORMS), dtype=bool)
KEPT[BODY, [T, H, P, I, S, POINT, COOKIE]] = True


def marginals(forms: np.ndarray, lengths: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product over all pages at once: zone marginals per line (pages, lines, zones) and expected zone steps.

    ``forms`` is padded with -1. The upward pass collects what the lines below say, the downward pass what stands above.
    """
    start, steps, shown = model
    pages, width = forms.shape
    seen = np.where(forms[:, :, None] >= 0, shown[:, np.maximum(forms, 0)].transpose(1, 2, 0), 1.0)
    up = np.ones((pages, width, N_ZONES))
    for k in range(width - 2, -1, -1):
        message = (seen[:, k + 1] * up[:, k + 1]) @ steps.T
        message /= message.sum(axis=1, keepdims=True)
        up[:, k] = np.where((k + 1 < lengths)[:, None], message, 1.0)
    out, moved = np.zeros((pages, width, N_ZONES)), np.zeros((N_ZONES, N_ZONES))
    down = np.broadcast_to(start, (pages, N_ZONES))
    for k in range(width):
        here = down * seen[:, k]
        belief = here * up[:, k]
        out[:, k] = belief / belief.sum(axis=1, keepdims=True)
        if k + 1 < width:
            pair = here[:, :, None] * steps[None] * (seen[:, k + 1] * up[:, k + 1])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            moved += pair[k + 1 < lengths].sum(axis=0)
        down = here @ steps
        down = down / down.sum(axis=1, keepdims=True)
    return out, moved


def _normal(counts: np.ndarray) -> np.ndarray:
    return counts / counts.sum(axis=-1, keepdims=True)


def prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _normal(START), _normal(STEPS), _normal(SHOWN)


def _padded(pages: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    forms = np.full((len(pages), int(lengths.max())), -1)
    for k, p in enumerate(pages):
        forms[k, : len(p)] = p
    return forms, lengths


def train(pages: list[list[int]], rounds: int = 3, weight: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Potentials from labelled pages: settled lines count in their zone, the others by their marginals."""
    model = prior()
    pages = [p for p in pages if p]
    if not pages:
        return model
    forms, lengths = _padded(sorted(pages))
    for _ in range(rounds):
        zones, moved = marginals(forms, lengths, model)
        shown, start = SHOWN.copy(), START + weight * zones[:, 0].sum(axis=0)
        for form in range(N_FORMS):
            counts = zones[forms == form].sum(axis=0)
            if form in SETTLED:
                counts = np.eye(N_ZONES)[SETTLED[form]] * counts.sum()
            # A form keeps the zones that its prior names; training sets how common it is there.
            shown[:, form] += weight * counts * (SHOWN[:, form] > 0.1)
        model = _normal(start), _normal(STEPS + weight * moved * (STEPS > 0.5)), _normal(shown)
    return model


class Forms(dict):
    """Line -> form; standing lines recur, so their forms are kept up to a bound."""

    def __missing__(self, line: str) -> int:
        out = form_of(line)
        if len(line) < 200:
            if len(self) > 300_000:
                self.clear()
            self[line] = out
        return out


def observed(text: str, title: str | None, known: Forms) -> tuple[list[int], list[int]]:
    """(line numbers, forms) of the lines that are not blank."""
    numbers, forms = [], []
    wanted = flat(title) if title and title.strip() else None
    size = len(title) if title else 0
    for k, line in enumerate(text.split("\n"), 1):
        if line.strip():
            form = known[line]
            if wanted and form in (H, S, P) and abs(len(line) - size) < size + 20 and flat(line) == wanted:
                form = T
            numbers.append(k)
            forms.append(form)
    return numbers, forms


def is_case(text: str) -> bool:
    """Whether a text is a page, not just a message in a page's place."""
    lines = [x for x in text.split("\n") if x.strip()]
    return not all(words_of(x) == "object object" for x in lines) and not is_message_page(lines)


SOURCES = {"page_data": ("page_id", "main_content"), "scraped_content": ("content_id", "content"), "broker_results": ("result_id", "full_text")}
LINES = "src_table string, rec_id bigint, line_no bigint, p_body double, is_body boolean"
BODIES = "src_table string, rec_id bigint, n_lines bigint, n_body bigint, main_body string"
BATCH = 512


def _pages(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for name, df in tables.items():
        rec, text = SOURCES[name]
        title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
        parts.append(df.select(F.lit(name).alias("src_table"), F.col(rec).cast("bigint").alias("rec_id"), F.col(text).alias("text"), title.alias("title")))
    return reduce(DataFrame.unionByName, parts).filter("rec_id is not null")


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, max_chars: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model trained on about ``max_pages`` pages (twice as many at most), chosen by a seeded hash."""
    n = max(1, pages.count())
    h = F.shiftrightunsigned(F.xxhash64("src_table", "rec_id", F.lit(SEED)), 1)
    sample = pages.filter(h < F.lit(min(2**63 - 1, int(max_pages / n * 2**63)))).filter(F.length("text") < max_chars).limit(2 * max_pages)
    known = Forms()
    return train([observed(r.text, r.title, known)[1] for r in sample.select("text", "title").collect() if is_case(r.text)])


def _zoned(rows: list[tuple], known: Forms, model: tuple) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """(pages as (src_table, rec_id, line numbers, forms, text), lines of each, p_body of all lines) for rows (src_table, rec_id, text, title)."""
    seen = [(s, i, *observed(t, h, known), t) for s, i, t, h in rows if t is not None and is_case(t)]
    # Pages of like length are padded together.
    seen = sorted((x for x in seen if x[2]), key=lambda x: len(x[2]))
    for a in range(0, len(seen), BATCH):
        part = seen[a : a + BATCH]
        forms, lengths = _padded([x[3] for x in part])
        step = max(1, 2_000_000 // (forms.shape[1] * N_ZONES))
        zones = np.concatenate([marginals(forms[b : b + step], lengths[b : b + step], model)[0] for b in range(0, len(part), step)])
        yield part, lengths, (zones * KEPT.T[np.maximum(forms, 0)]).sum(axis=2)[forms >= 0]


def judged(tables: dict[str, DataFrame], max_pages: int = MAX_PAGES) -> DataFrame:
    """(src_table, rec_id, line_no, p_body, is_body) of every line that is not blank."""
    pages = _pages(tables).filter("text is not null")
    model = fit(pages, max_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forms()
        for batch in batches:
            for part, lengths, body in _zoned(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), known, model):
                names = np.repeat(np.array([x[0] for x in part], dtype=object), lengths)
                ids = np.repeat(np.array([x[1] for x in part], dtype=np.int64), lengths)
                numbers = np.concatenate([np.array(x[2], dtype=np.int64) for x in part])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids), pa.array(numbers), pa.array(body), pa.array(body >= 0.5)], names=[x.split(" ")[0] for x in LINES.split(", ")])

    return pages.mapInArrow(run, LINES)


def found(tables: dict[str, DataFrame]) -> DataFrame:
    """(src_table, rec_id, line_no): each line outside the main body, once."""
    return judged(tables).filter("not is_body").select("src_table", "rec_id", "line_no").distinct()


def main_bodies(tables: dict[str, DataFrame], max_pages: int = MAX_PAGES) -> DataFrame:
    """(src_table, rec_id, n_lines, n_body, main_body): each page without the lines of ``found``; all pages come out.

    ``n_lines`` and ``n_body`` count lines that are not blank. A null text stays null, a mere message stays as it is.
    """
    pages = _pages(tables)
    model = fit(pages.filter("text is not null"), max_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forms()
        for batch in batches:
            rows, out, judged_ids = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), [], set()
            for part, lengths, body in _zoned(rows, known, model):
                for (s, i, numbers, _, text), own in zip(part, np.split(body >= 0.5, np.cumsum(lengths)[:-1]), strict=True):
                    gone = {n for n, keep in zip(numbers, own.tolist(), strict=True) if not keep}
                    out.append((s, i, len(numbers), len(numbers) - len(gone), "\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in gone)))
                    judged_ids.add((s, i, text))
            for s, i, text, _ in rows:
                if (s, i, text) not in judged_ids:
                    n = sum(1 for x in (text or "").split("\n") if x.strip())
                    out.append((s, i, n, n, text))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in BODIES.split(", ")])

    return pages.mapInArrow(run, BODIES).distinct()
