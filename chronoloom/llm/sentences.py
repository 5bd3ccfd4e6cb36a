"""Sentence boundaries of subtitle texts across languages and scripts.

Two passes. The first learns, unsupervised and per language, from counts over all documents: abbreviations, sentence
starters and collocations by log-likelihood ratios, and adverts by how their addresses stand: an address that is said
comes in ever other cues, one that is advertised always in the same. Tasks count their own rows before anything is
shuffled. The second pass walks the cues of each document, blanks what nobody says, and classifies each possible end with
these statistics; cues are joined where one continues another.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chronoloom.session import cut_lineage

LEAST_SEEN = 5
ALWAYS = 0.6
ABBREVIATION = 0.3
LIKELY = 7.88
INSIDE = 0.2
MOST_WORDS = 200_000
MOST_UNITS = 20_000

_BREAK = r"(?:\r\n|\n|\r(?!\n))"
_TIME = r"[0-9Oo]{1,3}:[0-9Oo]{2}(?::[0-9Oo]{2})?[,.][0-9Oo]{1,3}"
#: The time line of a cue, from its first character on.
_TIME_LINE = re.compile(rf"{chr(0xFEFF)}?[^\S\r\n]*{_TIME}[^\S\r\n]*-->[^\S\r\n]*{_TIME}[^\r\n]*(?:{_BREAK}|$)")
_TIME_SIGNS = "0123456789:,."
_FIRST_CUE = re.compile(r"\d+\r?\n\d\d:\d\d:\d\d,\d\d\d --> \d\d:\d\d:\d\d,\d\d\d\r?\n")
_PLAIN_CUE = re.compile(r"\n" + _FIRST_CUE.pattern)
_EMPTY_LINE = re.compile(rf"(?:{_BREAK}|^)[^\S\r\n]*(?:{_BREAK}|$)")
_LINE_END = re.compile(r"[\r\n]")
_LINES = re.compile(r"[^\r\n]+")
_UNSPOKEN_HINT = re.compile("[<{\\[(*♪♫♬♩♭#（【［]")
_UNSPOKEN = re.compile(r"(?=[<{\[(（【［*])(?:</?[A-Za-z][^<>|\r\n]*>|\{\\[^{}]*\}|\[[^\[\]\r\n]*\]|\([^()\r\n]*\)|（[^（）\r\n]*）|【[^【】\r\n]*】|［[^［］\r\n]*］|(?<!\w)\*[^*\r\n]+\*(?!\w))")
_TAG = re.compile("</?[a-z]>")
_SONG = re.compile("[♪♫♬♩♭]|^[^\\S\\r\\n]*#[^#]*#?[^\\S\\r\\n]*$")
_SONG_HINT = re.compile("[♪♫♬♩♭#]")
_DASHES = "-–—‐−�"
_LABEL = re.compile(r"(\s*(?:[-–—‐−�]\s*)?)([^\W\d_a-z][^\r\na-zà-öø-ÿ:：]{1,30}?[:：])(?=\s)")
_DASH = re.compile(r"\s*[-–—‐−�](?![-–—‐−=])\s*(?=\S)")
_DASHED_LINE = re.compile(r"(?:^|[\r\n])\s*[-–—‐−�]")
_DASHED = re.compile(r"(?:^|[\r\n])\s*[-–—‐−�](?![-=])")
#: The period of a host name, by its form: small letters on both sides.
_HOST = re.compile(r"\.(?<=[a-z0-9-]{2}\.)[a-z]{2}")
_APART = re.compile(r"[\s,;!?]")

_OPEN, _CLOSE = "\"“„«「『《〈‹‘¿¡", "\"”“»」』》〉›’"
_MARK = re.compile(r"[.!?…。！？｡।॥؟;;；]+|(?<=\w)�+(?=\s|$)")
_INNER = re.compile("[.!?…。！？｡।॥؟;；�“„«「『《\"]")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”“„]*[”]|„[^“”„]*[“”]|«[^»«]*»|「[^」]*」|『[^』]*』|《[^》]*》")
_OPENED = re.compile(r"[“„«「『《\"]")
_TAIL = re.compile(r"(?:[^\S\r\n]?[»›](?!\w)|[\"”」』》〉’])*")
_WORD = re.compile(r"[^\s.,!?…:;\"“”«»„()\[\]<>。！？、，「」『』《》।؟،—–-]+")
_IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿]")
_THAI = re.compile("[ก-๿]")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿ก-๿]")
_RUN = "〇"  # what a run without spaces counts as: a token, but none that could be an abbreviation
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_FINAL = ".!?…。！？｡।॥؟;;；"
_HARD = set("!?。！？｡।॥؟;;；")
_TOKEN = re.compile(r"[^\W\d_][^\s,!?…:;\"“”«»„()\[\]<>。！？、，「」『』।؟،\r\n-]*")
_PAIR = re.compile(r"\.[^\S\r\n]+(?=([^\W_][^\s.,!?…:;\"“”«»„()<>।-]*))")
_PAIR_WORD = re.compile(r"(?:^|[(\"“„«])([^.,!?…\"“”«»„()<>\d-][^,!?…\"“”«»„()<>-]*)$")
_START = re.compile(rf" --> [^\r\n]*{_BREAK}(?=[^\w\r\n]*([^\s.,!?…:;\"“”«»„()\[\]<>。！？、，「」『』।؟،-]+))")

#: First and last code point of the letters of each script that is not Latin.
_SCRIPTS = {"greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF), "han": (0x3400, 0x9FFF), "hangul": (0xAC00, 0xD7A3)}
_OTHER_SCRIPT = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _SCRIPTS.values()) + "]")
_LEAST_LETTERS = 6
# fixed values: ISO 639 codes of three letters and the two-letter codes of the same languages
_CODES = {"eng": "en", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "spa": "es", "rus": "ru", "chi": "zh", "zho": "zh", "jpn": "ja", "kor": "ko", "ara": "ar", "tha": "th", "gre": "el", "ell": "el", "hin": "hi"}


_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0178\u02c6\u02dc\u2013-\u203a\u20ac\u2122]")
_HIGH_WORD = re.compile("[\u00c0-\u00ff]{4,}")
#: One-byte encodings by language, for texts that were read as Latin 1; Cyrillic where nothing is known.
_ONE_BYTE = {"el": ("cp1253",), "ar": ("cp1256",), "th": ("cp874",)}
_TO_BYTE = {ord(bytes([i]).decode("cp1252")): i for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_LEAD = re.compile("[\u00c0-\u00ff]")


@lru_cache(maxsize=8)
def _table(encoding: str) -> dict[int, str]:
    return {i: bytes([i]).decode(encoding, "replace") for i in range(128, 256)}


def repaired(text: str, label: str | None = None, placed: bool = True) -> tuple[str, list[int] | None]:
    """A text that was read in a wrong encoding, read rightly, and where each character ends in the original.

    UTF-8 read as a one-byte encoding, also more than once, is read again; a one-byte encoding read as Latin 1 keeps
    its length. The list is None where no place changes, or where it is not asked for. Other texts come back as they are.
    """
    if text.isascii() or not _LEAD.search(text):
        return text, None
    places: np.ndarray | None = None
    lead = text[:1] == "\ufeff"
    for _ in range(3):
        if not _MISREAD.search(text):
            break
        try:
            fixed = text[lead:].translate(_TO_BYTE).encode("latin-1").decode("utf-8")
        except UnicodeError:
            break
        if placed:
            points = np.frombuffer(fixed.encode("utf-32-le"), np.uint32)
            ends = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)) + lead
            ends = np.concatenate([[1], ends]) if lead else ends
            places = ends if places is None else places[ends - 1]
        text = "\ufeff" * lead + fixed
        lead = text[:1] == "\ufeff"
    if len(_HIGH_WORD.findall(text)) >= 3:
        known = _ONE_BYTE.get((label or "").lower()[:2], ("cp1251", "koi8-r"))
        made = [text.translate(_table(e)) for e in known]
        text = max(made, key=lambda t: sum(map(str.islower, t)))
    return text, None if places is None else places.tolist()


@lru_cache(maxsize=65_536)
def _script_of(c: str) -> str:
    at = ord(c)
    return next((name for name, (first, last) in _SCRIPTS.items() if first <= at <= last), "")


def language_of(label: str | None, text: str) -> str:
    """Script/language: the script with most different letters in the text, and the language that the label names."""
    script = "latin"
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        letters = Counter(map(_script_of, set(text)))
        del letters[""]
        most = "kana" if letters["kana"] >= 3 else max(letters, key=letters.__getitem__, default="latin")
        if letters[most] >= _LEAST_LETTERS:
            script = most
    code = (label or "").strip().lower()[:3].rstrip("-_")
    code = _CODES.get(code, code[:2])
    if not (code.isascii() and code.isalpha()):  # so there are few languages, whatever the labels
        code = ""
    return f"{script}/{code}"


def head_of(text: str, at: int) -> str:
    """What stands for the word at a place: two characters in scripts without spaces, digits as 0."""
    found = _WORD.match(text, at)
    if not found:
        return ""
    word = found.group()
    if _IDEOGRAPH.match(word) or _IDEOGRAPH.search(word[:3]):
        word = re.sub(r"\d+", "0", word)[:2]
    return re.sub(r"\d+", "0", word) if word[0].isdigit() else word


@lru_cache(maxsize=100_000)
def _head(word: str) -> str:
    return head_of(word, 0)


def _blank(found: re.Match) -> str:
    return " " * (found.end() - found.start())


def _begin_of(text: str, end: int) -> int:
    """Where the run without white space that ends at a place begins."""
    begin = text.rfind(" ", 0, end) + 1
    for sign in "\n\r\t":  # each search ends where the one before it did
        begin = max(begin, text.rfind(sign, begin, end) + 1)
    return begin


def _word_before(text: str, at: int) -> tuple[int, int]:
    """Begin and end of the last run without white space that ends before a place; twice 0 where there is none."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    return _begin_of(text, end), end


def _marked(text: str, arrow: int) -> bool:
    """Whether what stands before a cue's number and time ends with a mark or a closing quotation mark."""
    near = text[max(0, arrow - 60) : arrow].split()
    if len(near) > 2:  # the time, a number or what stands for it, and the end of what comes before
        last = near[-2] if not near[-2].isdigit() else near[-3]
        return last[-1] in _FINAL or last[-1] in _CLOSE
    at, _ = _word_before(text, arrow)  # the time
    begin, end = _word_before(text, at)
    if end and text[begin:end].isdigit():
        begin, end = _word_before(text, begin)
    return end > 0 and (text[end - 1] in _FINAL or text[end - 1] in _CLOSE)


def _without_times(text: str) -> str:
    """The text without most of its times, which hold no letter and would be most of its different words."""
    parts = text.split(" --> ")
    for i, part in enumerate(parts):
        begin = 12 if not part[:12].strip(_TIME_SIGNS) else 0
        end = len(part) - 12 if not part[-12:].strip(_TIME_SIGNS) else len(part)
        parts[i] = part[begin:end]
    return " ".join(parts)


def _addresses(text: str) -> list[int]:
    """Places inside whatever has the form of an address: a host name, a scheme or an @."""
    found = [m.start() for m in _HOST.finditer(text)]
    for sign in ("@", "://"):
        at = text.find(sign)
        while at >= 0:
            found.append(at)
            at = text.find(sign, at + 1)
    return sorted(found)


def _end_of(text: str, at: int) -> int:
    """Where the run around a place ends, at white space or a mark that no address has."""
    found = _APART.search(text, at)
    return found.start() if found else len(text)


def _body(text: str, at: int) -> str:
    """The text of the cue around a place, its white space made even."""
    a = text.rfind("-->", 0, at)
    if a < 0:
        return ""
    b = text.find("-->", at)
    body = text[a : b if b >= 0 else len(text)]
    line = _LINE_END.search(body)
    return _even(body[line.start() :]) if line else ""


def _even(body: str) -> str:
    """A cue's text up to its first empty line, white space made even."""
    empty = _EMPTY_LINE.search(body, 1)
    return " ".join((body[: empty.start()] if empty else body).split())


def _count(schema: pa.Schema):
    """Rows (lang, text) to counts (language, kind, item, n) of each task; what is counted leaves whenever it is many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict[str, Counter]] = {}
        words: dict[str, Counter] = {}

        def take_apart(language: str) -> None:
            tokens = totals[language]["token"]
            for word, n in words[language].items():
                if word[0].isdigit() and word.isascii() and word.upper() == word.lower():
                    continue  # without a letter there is no token
                for token in _TOKEN.findall(word):
                    tokens[token if not _UNSPACED.match(token) else _RUN] += n
            words[language].clear()

        def leave() -> Iterator[pa.RecordBatch]:
            rows = [(language, kind, item, n) for language, kinds in totals.items() for kind, counter in kinds.items() for item, n in counter.items()]
            totals.clear()
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[at : at + 50_000], strict=True), schema, strict=True)], schema=schema)

        gc.disable()  # the counting makes many small objects and no cycles
        try:
            for batch in batches:
                grouped: dict[str, list[str]] = {}
                for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text:
                        text = repaired(text, label, False)[0]
                        grouped.setdefault(language_of(label, text), []).append(text)
                for language, texts in grouped.items():
                    kinds = totals.setdefault(language, {k: Counter() for k in ("token", "start", "late", "pair", "address")})
                    own = words.setdefault(language, Counter())
                    whole = _TAG.sub(_blank, "\n\n".join(texts))
                    own.update(_without_times(whole).split())
                    for found in _PAIR.finditer(whole):
                        i = found.start()
                        before = _PAIR_WORD.search(whole[_begin_of(whole, i) : i])
                        if before:
                            after = found.group(1)
                            kinds["pair"][f"{before.group(1).lower()} {'0' if after[0].isdigit() else after}"] += 1
                    for found in _START.finditer(whole):
                        head = _head(found.group(1))
                        if head:
                            kinds["start" if _marked(whole, found.start()) else "late"][head] += 1
                    end = 0
                    for at in _addresses(whole):
                        if at >= end:
                            begin, end = _word_before(whole, at)[0], _end_of(whole, at)
                            kinds["address"][f"{whole[begin:end]} {_body(whole, at)}"] += 1
                    if len(own) > MOST_WORDS:
                        take_apart(language)
                if sum(len(c) for kinds in totals.values() for c in kinds.values()) > MOST_WORDS:
                    for language in totals:
                        take_apart(language)
                    yield from leave()
            for language in totals:
                take_apart(language)
            yield from leave()
        finally:
            gc.enable()

    return run


def _likelihood(both: Column, one: Column, two: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio that one (count one, two of them with the other) depends on the other."""

    def term(k: Column, m: Column, p: Column) -> Column:
        safe = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(safe) + (m - k) * F.log(1 - safe)

    p, p1, p2 = two / n, both / one, (two - both) / F.greatest(n - one, F.lit(1.0))
    return -2 * (term(both, one, p) + term(two - both, n - one, p) - term(both, one, p1) - term(two - both, n - one, p2))


def learned(df: DataFrame, text: str, lang: str) -> DataFrame:
    """language, kind ('abbreviation', 'starter', 'collocation'), item: what all documents together show.

    Every kind is learned per language and over all languages of a script (language 'script/'), for texts whose label
    is missing or wrong. The rules are the same for every size of the input: an item must be seen LEAST_SEEN times and be
    likely enough, and all such items are held.
    Adverts ('advert', the cue's even text) are learned over all languages together (language '').
    """
    schema = StructType([StructField("language", StringType()), StructField("kind", StringType()), StructField("item", StringType()), StructField("n", LongType())])
    counts = df.select(F.col(f"`{lang}`").cast("string"), F.col(f"`{text}`").cast("string")).mapInArrow(_count(to_arrow_schema(schema)), schema)
    both = F.array(F.col("language"), F.concat(F.substring_index("language", "/", 1), F.lit("/")))
    counts = counts.withColumn("language", F.explode(F.array_distinct(both))).groupBy("language", "kind", "item").agg(F.sum("n").cast("double").alias("n"))
    counts = cut_lineage(counts)  # read five times below, while a pass over the texts is dear

    tokens = counts.where("kind = 'token'")
    dotted = F.col("item").endswith(".")
    bare = F.lower(F.when(dotted, F.expr("substring(item, 1, length(item) - 1)")).otherwise(F.col("item")))
    types = tokens.select("language", bare.alias("word"), F.when(dotted, F.col("n")).otherwise(0.0).alias("dots"), "n").where("word <> ''")
    types = types.groupBy("language", "word").agg(F.sum("dots").alias("both"), F.sum("n").alias("one"))
    sums = types.groupBy("language").agg(F.sum("both").alias("two"), F.sum("one").alias("n"))
    typed = types.join(sums, "language").where(F.col("both") >= LEAST_SEEN)
    periods = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - periods
    typed = typed.withColumn("score", _likelihood(F.col("both"), F.col("one"), F.col("two"), F.col("n")) * F.exp(-letters.cast("double")) * (periods + 1))
    starts = counts.where("kind in ('start', 'late')").groupBy("language", "item").agg(F.sum(F.when(F.col("kind") == "start", F.col("n")).otherwise(0.0)).alias("both"), F.sum("n").alias("heads"))
    words = tokens.select("language", F.regexp_replace("item", r"\.$", "").alias("item"), "n").groupBy("language", "item").agg(F.sum("n").alias("seen"))
    starts = starts.join(words, ["language", "item"], "left").withColumn("one", F.greatest(F.coalesce("seen", "heads"), "heads"))
    totals = starts.groupBy("language").agg(F.sum("both").alias("two"))
    found = starts.join(totals, "language").join(sums.select("language", "n"), "language")
    found = found.where((F.col("both") >= LEAST_SEEN) & (F.col("both") >= 0.2 * F.col("one")) & (F.col("both") >= 0.6 * F.col("heads")))
    found = found.withColumn("score", _likelihood(F.col("both"), F.col("one"), F.col("two"), F.greatest(F.col("n"), F.col("two") * 2))).where(F.col("score") > LIKELY)
    starters = found.where("item <> '0'").select("language", F.lit("starter").alias("kind"), "item")

    pairs = counts.where("kind = 'pair'").select("language", F.substring_index("item", " ", 1).alias("word"), F.substring_index("item", " ", -1).alias("next"), F.col("n").alias("both"))
    # an abbreviation is often followed by what begins no sentence; a word that merely tends to come last is not
    inside = pairs.join(starters.select("language", F.col("item").alias("next")), ["language", "next"], "left_anti").groupBy("language", "word").agg(F.sum("both").alias("inside"))
    mostly = (letters <= 1) | (F.col("both") >= ALWAYS * F.col("one"))  # a share: a number of bare ones would rule out more the larger the input
    likely = typed.where((F.col("score") >= ABBREVIATION) & mostly & (F.col("both") / F.col("one") > F.col("two") / F.col("n")) & ~F.col("word").endswith("."))
    abbreviations = likely.join(inside, ["language", "word"]).where(F.col("inside") >= INSIDE * F.col("both")).select("language", F.lit("abbreviation").alias("kind"), F.col("word").alias("item"))
    first = types.select("language", "word", F.col("both").alias("one"))
    paired = pairs.join(first, ["language", "word"]).join(words.withColumnRenamed("item", "next"), ["language", "next"]).join(sums.select("language", "n", "two"), "language")
    paired = paired.where((F.col("both") >= LEAST_SEEN) & (F.col("both") < F.col("one") + 1))
    paired = paired.withColumn("score", _likelihood(F.col("both"), F.greatest("one", "both"), F.greatest("seen", "both"), F.col("n")))
    paired = paired.where((F.col("score") > LIKELY) & (F.col("n") / F.col("one") > F.col("seen") / F.col("both")))
    collocations = paired.select("language", F.lit("collocation").alias("kind"), F.concat("word", F.lit(" "), "next").alias("item"))

    # an address that is said stands in ever other cues, one that is advertised always in the same
    stood = counts.where("kind = 'address' and endswith(language, '/')").groupBy("item").agg(F.sum("n").alias("n"))
    stood = stood.select(F.substring_index("item", " ", 1).alias("address"), F.expr("substring(item, instr(item, ' ') + 1)").alias("item"), "n")
    every = stood.groupBy("address").agg(F.sum("n").alias("one"))
    adverts = stood.join(every, "address").where((F.col("n") >= LEAST_SEEN) & (F.col("n") >= ALWAYS * F.col("one")))
    adverts = adverts.select(F.lit("").alias("language"), F.lit("advert").alias("kind"), "item").distinct()
    return abbreviations.unionByName(starters).unionByName(collocations).unionByName(adverts)


class Splitter:
    """Ends of the sentences of one document after another, with what was learned."""

    def __init__(self, model: dict[str, dict[str, set[str]]]) -> None:
        self._model = model
        self._learned: dict[str, tuple[set[str], ...]] = {}
        self._memos: dict[str, dict[str, tuple]] = {}
        self._adverts = model.get("", {}).get("advert", set())

    def ends(self, text: str | None, label: str | None = None) -> list[int]:
        """The number of code points up to and including each sentence's last character, in order."""
        if not text or "-->" not in text:
            return []
        fixed, places = repaired(text, label)
        language = language_of(label, fixed)
        if language not in self._learned:
            own, script = self._model.get(language, {}), self._model.get(language.split("/")[0] + "/", {})
            self._learned[language] = tuple(own.get(k, set()) | script.get(k, set()) for k in ("abbreviation", "starter", "collocation"))
        self._abbreviations, self._starters, self._collocations = self._learned[language]
        self._memo = self._memos.setdefault(language, {})
        found: list[int] = []
        self._found = found
        self._pending, self._kind, self._quote = 0, "", ""
        cues = self._cues(fixed)
        offers = _addresses(fixed) if self._adverts else []
        offers.append(len(fixed) + 1)
        said = _UNSPOKEN.sub(_blank, fixed) if _UNSPOKEN_HINT.search(fixed) else fixed
        self._songs = bool(_SONG_HINT.search(said))
        self._is_thai = language.startswith("thai")
        self._is_greek = language.startswith("greek")
        nth = 0
        for (_, a), (b, _) in zip(cues, [*cues[1:], (len(fixed), 0)], strict=True):
            while offers[nth] < a:
                nth += 1
            empty = _EMPTY_LINE.search(said, a, b) if said[a : a + 1] in "\r\n" or fixed.find("\n\n", a, b) < 0 else None
            end = empty.start() if empty else fixed.find("\n\n", a, b)
            if end < 0:
                end = b
            if offers[nth] < end:
                body = fixed[a:end]
                if " ".join(_TAG.sub(_blank, body).split()) in self._adverts:
                    self._close()
                    found.append(a + len(body.rstrip()))
                    continue
            self._cue(said[a:end], a)
        self._close()
        if places is not None:
            return [places[e - 1] for e in found]
        return found

    @staticmethod
    def _cues(text: str) -> list[tuple[int, int]]:
        """Where the number or time line of each cue begins and where its time line ends."""
        first = _FIRST_CUE.match(text)
        if first:
            found = [first.span(), *((m.start() + 1, m.end()) for m in _PLAIN_CUE.finditer(text, first.end() - 1))]
            if len(found) == text.count("-->"):
                return found  # every time line stands below its number, in the usual form
        found = []
        arrow = text.find("-->")
        while arrow >= 0:
            line = max(text.rfind("\n", 0, arrow), text.rfind("\r", 0, arrow)) + 1
            time = _TIME_LINE.match(text, line)
            if time:
                first = line
                before = line - 2 if text[line - 2 : line] == "\r\n" else line - 1
                if before > 0:
                    number = max(text.rfind("\n", 0, before), text.rfind("\r", 0, before)) + 1
                    if text[number:before].strip("\ufeff \t").isdigit():
                        first = number
                found.append((first, time.end()))
            arrow = text.find("-->", arrow + 3)
        return found

    def _close(self) -> None:
        if self._pending:
            self._found.append(self._pending)
        self._pending, self._kind, self._quote = 0, "", ""

    def _cue(self, body: str, base: int) -> None:
        if not (self._songs or self._is_thai or ":" in body or "：" in body or _DASHED_LINE.search(body)):
            said = body.strip()  # every line belongs to one unit
            if said:
                if "\n" in said or "\r" in said:
                    said = said.replace("\n", " ").replace("\r", " ")
                self._unit(said, base + body.index(said[0]), False, [])
            return
        units: list[list] = []
        for line in _LINES.finditer(body):
            said = line.group()
            if said.isspace() or self._songs and _SONG.search(said):
                continue
            a, hard = line.start(), False
            if ":" in said or "：" in said:
                label = _LABEL.match(said)
                if label and sum(map(str.isupper, label.group(2))) >= 2:
                    said = " " * label.end() + said[label.end() :]
                    hard = True
            first = said.lstrip()[:1]
            if first in _DASHES and first:
                dash = _DASH.match(said)
                if dash and (not said[dash.end()].islower() or len(_DASHED.findall(body)) > 1):
                    hard = True
                    said = " " * dash.end() + said[dash.end() :]
            if units and not hard:
                units[-1][1] += " " * (a - units[-1][0] - len(units[-1][1])) + said
                units[-1][3].append(a - units[-1][0])
            elif not said.isspace():
                units.append([a, said, hard, []])
        for a, said, hard, wraps in units:
            self._unit(said, base + a, hard, wraps)

    def _starts(self, said: str, at: int) -> bool:
        """Whether a known sentence starter stands at a place."""
        return head_of(said, at) in self._starters

    def _continues(self, said: str, at: int) -> bool:
        """Whether a unit carries on the unfinished sentence before it."""
        c = said[at]
        if c in ".…":
            return True
        if self._quote:
            return True
        if c in "¿¡":
            return False
        while c in _OPEN and at + 1 < len(said):
            at += 1
            c = said[at]
        if _THAI.match(c):
            return False
        if c.islower() or c in ",;:)-–—":
            return True
        if self._kind == "ellipsis" and c.isupper():
            return False
        if not c.isalnum() and not _WORD.match(said, at):
            return False
        return not self._starts(said, at)

    def _unit(self, said: str, base: int, hard: bool, wraps: list[int]) -> None:
        if self._pending:
            at = len(said) - len(said.lstrip())
            if hard and not (self._quote and said[at:].find(self._quote) >= 0) or not self._continues(said, at):
                self._close()
        quote_to = 0
        if self._quote:
            there = said.find(self._quote)
            quote_to = there + 1 if there >= 0 else 0
        if self._is_thai and _THAI.search(said):
            self._thai(said, base, wraps)
            return
        if quote_to:
            analysed = self._analysed(said, quote_to)
        else:
            analysed = self._memo.get(said)
            if analysed is None:
                analysed = self._analysed(said, 0)
                if len(self._memo) >= MOST_UNITS:
                    self._memo.clear()
                self._memo[said] = analysed
        ends, pending, kind, self._quote = analysed
        if ends:
            self._found += [base + e for e in ends]
            self._pending, self._kind = 0, ""
        if pending:
            self._pending, self._kind = base + pending, kind

    def _analysed(self, said: str, quote_to: int) -> tuple[list[int], int, str, str]:
        """Ends in a unit, where its unfinished rest ends (or 0), the kind of that end and the mark that would close its open quotation."""
        n = len(said.rstrip())
        ends: list[int] = []
        spans = [(0, quote_to)] if quote_to else []
        left_open, opened = "", None
        if not quote_to and said[n - 1] in "!?" and not _INNER.search(said, 0, n - 1):
            return [n], 0, "", ""  # one mark, and it is the last character
        if _OPENED.search(said):
            spans += [m.span() for m in _QUOTED.finditer(said, quote_to)]
            opened = _OPENED.search(said, spans[-1][1] if spans else 0)
            if opened:
                left_open = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "《": "》", '"': '"'}[opened.group()]
        greek = self._is_greek
        done, k = 0, 0
        stop = opened.start() if opened else n
        for m in _MARK.finditer(said, 0, n):
            i, j = m.span()
            mark = m.group()
            if ";" in mark and not greek:
                continue
            while k < len(spans) and spans[k][1] <= i:
                k += 1
            if k < len(spans) and spans[k][0] <= i:
                # inside a quotation: only what closes it can end the sentence
                end = spans[k][1]
                if said[j : end - 1].strip():
                    continue
                j, quoted = end, True
            elif i >= stop:
                break
            else:
                quoted = False
                if j != stop and not (k < len(spans) and spans[k][0] == j):  # else a quotation opens right here
                    j = _TAIL.match(said, j).end()
            verdict = self._ends(said, i, mark, j, n, quoted)
            if verdict == "yes":
                ends.append(j)
                done = j
            elif verdict:
                return ends, n, verdict, ""
        if said[done:n].strip():
            return ends, n, "open", left_open
        return ends, 0, "", ""

    def _thai(self, said: str, base: int, wraps: list[int]) -> None:
        """Thai has no marks: a line, a cue and a space end a sentence, but not a space beside a number."""
        self._quote = ""
        done = 0
        n = len(said.rstrip())
        for m in re.finditer(r"\s+", said[:n]):
            a, b = m.span()
            if a <= done and not said[done:a].strip():
                continue
            before, after = said[a - 1], said[b]
            line = any(a <= w <= b for w in wraps)
            if not line and (before.isdigit() or after.isdigit() or before in ".,:-–—" or not _THAI.match(after) and after not in _OPEN and not after.isupper()):
                continue
            if before in _FINAL and before != "." or _THAI.match(before) or before in _CLOSE or line:
                self._pending = base + a
                self._close()
                done = b
        if said[done:n].strip():
            self._pending = base + n
            self._close()

    def _ends(self, said: str, i: int, mark: str, j: int, n: int, quoted: bool) -> str:
        """'yes', '' for no, or the kind of end that the next cue decides."""
        dots = mark == "."
        ellipsis = not dots and not (_HARD & set(mark))
        k = j
        while k < n and said[k].isspace():
            k += 1
        if k >= n:
            if ellipsis:
                return "ellipsis"
            if dots and not quoted and self._short(said, i):
                return "short"
            return "quoted" if quoted else "yes"
        c = said[k]
        spaced = k > j
        while c in _OPEN and k + 1 < n:
            k += 1
            c = said[k]
            if c.isspace():
                return "yes" if not dots or not self._short(said, i) else ""
        if c in "-–—" and k + 1 < n:
            then = said[k + 1 :].lstrip()[:1]
            return "" if then.islower() or not spaced else "yes"
        if c.islower() or c in ",:;)%/&=@":
            return ""
        if c.isdigit():
            if dots:
                if spaced and self._short(said, i):
                    return "yes" if len(head_of(said, k)) > 1 and self._starts(said, k) else ""
                return "yes" if spaced else ""
            if ellipsis:
                return "" if not _IDEOGRAPH.search(said) or not self._starts(said, k) else "yes"
            return "yes"
        if not c.isalpha() and not _WORD.match(said, k):
            return ""
        if quoted:
            if c.isupper():
                return "yes" if not dots or self._starts(said, k) or spaced else ""
            return "yes" if self._starts(said, k) else ""
        if ellipsis:
            return "yes" if c.isupper() or self._starts(said, k) else ""
        if not dots:
            return "yes"
        if not spaced:
            word = said[:i].split()[-1] if said[:i].split() else ""
            return "yes" if len(word) > 2 and word[-1].islower() and "." not in word and self._starts(said, k) and not self._short(said, i) else ""
        if self._short(said, i):
            return "yes" if self._starts(said, k) else ""
        return "" if self._joined(said, i, k) else "yes"

    @staticmethod
    def _before(said: str, i: int) -> str:
        a = i
        while a > 0 and not said[a - 1].isspace() and said[a - 1] not in "(\"“„«-–—":
            a -= 1
        return said[a:i]

    def _short(self, said: str, i: int) -> bool:
        """Whether the period at i belongs to an abbreviation, an initial or a number."""
        word = self._before(said, i)
        if not word:
            return False
        if word[-1].isdigit() or len(word) == 1 and word.isalpha():
            return True
        if "." in word:
            parts = word.split(".")
            if max(map(len, parts)) <= 3:
                return True
            if not parts[0].isupper() and parts[-1][:1].isupper():  # a space is missing after a period
                word = parts[-1]
                if len(word) == 1:
                    return True
        return word.lower() in self._abbreviations

    def _joined(self, said: str, i: int, k: int) -> bool:
        """Whether the words on both sides of a period are a collocation that is no start."""
        if not self._collocations or self._starts(said, k):
            return False
        found = _WORD.match(said, k)
        return bool(found) and f"{self._before(said, i).lower()} {found.group()}" in self._collocations


def _split(model: dict[str, dict[str, set[str]]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(model)
        gc.disable()  # the walk makes many small objects and no cycles
        try:
            for batch in batches:
                rows, ends = [], []
                for at, (label, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    found = splitter.ends(text, label)
                    ends += found
                    rows += [at] * len(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ends, pa.int64())], schema=schema)
        finally:
            gc.enable()

    return run


def sentence_ends(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """key, end_char: one row for each sentence spoken in the cues of each text, by its last code point.

    A null or empty text, or one without cues, has no sentences. Repeated rows come out repeatedly, a null key stays
    null; a null, unknown or wrong lang falls back on what the script's texts have in common. The model that goes to
    the tasks holds at most MOST_ITEMS items of each kind per language, whatever the size of the corpus.
    """
    model: dict[str, dict[str, set[str]]] = {}
    for row in learned(df, text, lang).toLocalIterator():
        model.setdefault(row.language, {}).setdefault(row.kind, set()).add(row.item)
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("end_char", LongType())])
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{lang}`").cast("string").alias("_lang"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(_split(model, to_arrow_schema(schema)), schema)
