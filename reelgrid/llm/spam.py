"""Pages made for searchers: repeated keywords, link lists, tags of wares (problem 8).

Blocks of a page are compressed, after addresses and tags in them are taken out and digits
made alike, as lists of links and stock numbers repeat nothing but their form.  A block's
compression ratio is set against what pages of its language usually reach at its length in
the corpus (median and spread).  It is suspect if it is far more redundant than that and if
at most HELD of it are sentences that say something: a sentence does if enough of its words
stand nowhere else on the page.  A page of which suspect blocks hold SUSPECT of the text is
a candidate, in whatever language.

An exact check follows.  The page is read in pieces (lines, and items between separators),
and each piece is counted as drawing searchers or not: outside links with labels that don't
name the page or a source, runs of tags, stock numbers with prices, and items of which nearly
all words come again and again.  Of items that end as sentences do, repetition counts only
where the words come in ever other company (shuffled), as keywords do; sentences made from
a pattern repeat their order too.  What an encyclopedia repeats by itself (verse, internal
links, tables of figures, timetables, species, templates, source lists) never counts.  More
than half of the text must.  There are no lists of words.

The corpus is read twice, for the usual ratios and for the pages, as compressing costs little
beside the rest, which is done for redundant pages only.  Of the first reading only counts
by language, length and ratio are shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a block, up to the next blank; a rest of less than a third joins the last.
BLOCK = 250
#: Characters from which a paragraph's end is a block's end.
PARAGRAPH = 30
#: Spreads below the median ratio from which a block is redundant.
REDUNDANT = 0.4
#: The ratio below which it is where the corpus has too few pages to tell what is usual.
UNKNOWN = 0.5
#: Share of a block's characters in sentences that say something, from which it isn't suspect.
HELD = 0.7
#: Share of a sentence's words that must stand nowhere else on the page for it to say something.
NEW = 0.34
#: Share of the text in suspect blocks from which a page is a candidate.
SUSPECT = 0.5
#: Pages that a language needs for ratios of its own at a length; else those of all count.
ENOUGH = 50
#: Steps of the ratio in which pages are counted.
BINS = 200
#: Share of the text that must draw searchers.
SHARE = 0.5
#: Of repeated words: different words after one for each time it stands, and different pairs for
#: each different word (at least, and for each root of the number of words), from which they are shuffled.
AFTER, PAIRS, PAIRS_ROOT = 0.62, 1.55, 0.11
#: Share of such an item's words that must be keywords.
MOST = 0.5
#: Words of a page up to which repetition counts from the second time on, else from the third.
SHORT_PAGE = 60
#: Items that don't end as sentences, from which they may be shuffled.
ITEMS = 4
#: Words of an item that ends as a sentence, up to which it may be a keyword phrase.
PHRASE = 24
#: Words of one up to which it may vary around a keyword.
SHORT = 8

# fixed values: words that mark a number as that of a ware
STOCK = r"(?:sku|ref|ean|art|id|item|no|арт|nr|품번)"

_ADDRESSES = re.compile(r"(?:(?:https?|hxxps?|ftp):)?//[^\s\]|<>\"']+|www\.[^\s\]|<>\"']+", re.I)
_PLACE = re.compile(r"<a\s[^<>]{0,500}>|</a>|<br ?/?>|&nbsp;|</?div[^<>]{0,200}>", re.I)
_LISTED = re.compile(r"(?:(?:https?|hxxps?|ftp):)?//[^\s\]|<>\"',;]+|www\.[^\s\]|<>\"',;]+", re.I)
_TAGGED = re.compile(r"#\w{3,}")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_MARKS = bytes.maketrans(b",;:()[]{}'\"|*=<>-/_#", b" " * 20)
_UNSPACED = re.compile(r"([\u3040-\u30ff\u3400-\u9fff])")
_BORDER = re.compile(r"\n(?=\n|<div|==)|(?<=.)(?=<div)")
# in scripts without blanks between words a character is one
_WORD = re.compile(r"[^\W\u3040-\u30ff\u3400-\u9fff]+|[\u3040-\u30ff\u3400-\u9fff]")
_LEET = str.maketrans("013457!", "oieast" + "i")

_VERSE = re.compile(r"<poem>.*?</poem>", re.S | re.I)
_BLANKS = re.compile(r"\{\{\{[^{}]*\}\}\}|\{\{(?:subst:)?[^{}|]*(?:\|(?:[^{}|=]{0,60}|[a-z]+=[^{}|]{0,60}|\s*))*\}\}")
_ANCHOR = re.compile(r"<a\s+href=[\"']?([^\"'>]*)[\"']?[^>]*>(.*?)</a>(?:\s|<br ?/?>|&nbsp;)*", re.S | re.I)
_LABELLED = re.compile(r"\[((?:(?:https?|hxxps?|ftp):)?//[^\s\]]+|www\.[^\s\]]+)\s*([^\]]*)\]", re.I)
_BEFORE = re.compile(r"\[\[([^\[\]|]*)\]\]\s*\[((?:(?:https?|hxxps?):)?//[^\s\]]+|www\.[^\s\]]+)\]", re.I)
_INTERNAL = re.compile(r"\[\[[^\[\]]*\]\]")
_TAG = re.compile(r"#[\w]{3,}[,;]?", re.U)
_STOCK = re.compile(rf"(?:\b{STOCK}\.?\s*:?\s*|#\s?)\d{{4,}}\b", re.I)
_YEAR = re.compile(r"\|\s*1[0-9]\d\d\s*\||\|\s*20\d\d\s*\|")
_OWN = re.compile(
    r"^\s*(?:\d{1,2}:\d\d\b|[#*]\s*[\"“'].*\d:\d\d\s*$|[*#]?\s*''[^']+''\s|\[\[\w+:|<ref|\*\s*\[\[|#\s*\[\[|!|\|-|\|\+|\{\||\|\}|\|\s*\w+\s*=\s*[^|]{0,60}$|\|.*\|\|)",
)
_SPLIT = re.compile(r"(?<=。)|\s+[-–—|/*·•]+\s+|\s*[;•·|]\s*|(?<=[.!?])\s+|\s*<br ?/?>\s*|,\s+(?=#)")
_MARKUP = re.compile(r"<!--|-->|</?div[^>]*>|\{\{Infobox[^|{}]*|\}\}|'''?|==+", re.I)


def plain(text: str) -> str:
    """Lower case, without marks on letters, and with digits inside words read as letters."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.lower()


def _words(text: str) -> list[str]:
    out = []
    for w in _WORD.findall(text):
        if not w.isalpha() and not w.isdigit():
            w = w.translate(_LEET)
        out.append(w)
    return out


def blocks(text: str) -> Iterator[str]:
    """The whole text in blocks of about BLOCK characters; paragraphs and hidden parts begin new ones."""
    at, n = 0, len(text)
    while at < n:
        end = at + BLOCK
        border = _BORDER.search(text, at + PARAGRAPH, min(end, n))
        if border and n - border.end() > PARAGRAPH:
            end = border.end()
        elif n - end < BLOCK // 3:
            end = n
        else:
            end = text.find(" ", end, end + 80) + 1 or end
        yield text[at:end]
        at = end


Block = tuple[int, int, float, bytes]


def ratios(text: str) -> list[Block]:
    """Length, bytes, compression ratio and text of each block, with addresses, tags and digits made alike."""
    out = []
    for b in blocks(text):
        alike = b.lower()
        if "<" in alike or "&" in alike:
            alike = _PLACE.sub("", alike)
        if "//" in alike or "www." in alike:
            alike = _LISTED.sub("\x01", alike)
        if "#" in alike:
            alike = _TAGGED.sub("\x02", alike)
        raw = alike.encode("utf-8", "surrogatepass").translate(_DIGITS)
        # what addresses and tags took counts as redundant
        size = len(b.encode("utf-8", "surrogatepass"))
        out.append((len(b), size, len(zlib.compress(raw, 6)) / size, raw))
    return out


def telling(found: list[Block]) -> list[float]:
    """The share of each block that is in sentences that say something: more than three words, enough of which stand nowhere else."""
    words = []
    for *_, raw in found:
        if raw.isascii() or not _UNSPACED.search(text := raw.decode("utf-8", "surrogatepass")):
            words.append(raw.translate(_MARKS).split())
        else:
            words.append(_UNSPACED.sub(r" \1 ", text.replace("。", ". ")).encode("utf-8", "surrogatepass").translate(_MARKS).split())
    bare = [[w.rstrip(b".!?") for w in ws] for ws in words]
    seen = Counter(w for ws in bare for w in ws)
    out = []
    for (_, size, *_), ws, bs in zip(found, words, bare, strict=True):
        held = first = 0
        for i, w in enumerate(ws):
            if w[-1] in b".!?":
                sentence = bs[first : i + 1]
                n = len(sentence)
                if n > 3 and sum(seen[x] == 1 for x in sentence) >= NEW * n:
                    held += n + sum(map(len, sentence))
                first = i + 1
        out.append(held / size)
    return out


def _source(label: str, title: str) -> bool:
    """Whether a link's label names the page or a quoted work, as sources do."""
    return bool(title and title.lower() in label.lower()) or label.lstrip().startswith(('"', "“", "«", "''"))


def drawing_share(text: str, title: str | None, redundant: bool = True) -> float:
    """The share of the text that is there to draw searchers.

    redundant: whether phrases that end as sentences count by repetition too.
    """
    total = len(text)
    if total == 0:
        return 0.0
    title = (title or "").strip()
    if "<poem" in text:
        text = _VERSE.sub(" ", text)
    if "{{" in text:
        text = _BLANKS.sub(" ", text)
    drawn = 0

    def link(m: re.Match, label: str) -> str:
        nonlocal drawn
        if _source(label, title):
            return "\x02"
        drawn += len(m[0])
        return "\x01"

    if "//" in text or "www." in text:
        if "href" in text:
            text = _ANCHOR.sub(lambda m: link(m, m[2]), text)
        text = _BEFORE.sub(lambda m: link(m, m[1]), text)
        text = _LABELLED.sub(lambda m: link(m, m[2]), text)
        text = _ADDRESSES.sub(lambda m: link(m, ""), text)
    if text.count("#") >= 3:
        tags = _TAG.findall(text)
        if len(tags) >= 3:
            drawn += sum(len(t) + 1 for t in tags)
            text = _TAG.sub("\x01", text)

    kept: list[tuple[int, list[str], bool]] = []
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        if "\x01" in line and "||" in line:
            drawn += len(line)  # a row around an outside link
            continue
        if "\x01" not in line and (_OWN.match(line) or _YEAR.search(line)):
            continue
        if _STOCK.search(line):
            for item in re.split(r"\s+[-–·•*/]\s+", line):
                if _STOCK.search(item):
                    drawn += len(item) + 2
            continue
        line = _INTERNAL.sub(" ", line)
        for item in _SPLIT.split(_MARKUP.sub(" ", line)):
            if item and not item.isspace():
                words = _words(plain(item))
                if words:
                    kept.append((len(item) + 1, words, item.rstrip()[-1:] in ".!?。"))
    if not kept:
        return min(1.0, drawn / total)
    return min(1.0, (drawn + _repeated(kept, title, redundant)) / total)


def _repeated(kept: list[tuple[int, list[str], bool]], title: str, ended_too: bool) -> int:
    """Characters of the items that draw searchers by what they repeat.

    Repetition is counted from the second time on in a short page, from the third in others.
    """
    seen = Counter(w for _, words, _ in kept for w in words)
    count = sum(seen.values())
    again_from = 3 if count > SHORT_PAGE else 2
    named = {*_words(plain(title))}
    phrases = [words for _, words, ended in kept if ended and len(words) <= PHRASE] if ended_too else []
    free = len(phrases) > 2 and shuffled(phrases, again_from)
    keywords = {w for w, n in _standing(phrases).items() if n >= again_from and w not in named} if free else set()
    short = [p for p in phrases if len(p) <= SHORT]
    central = {w for w, n in _standing(short).items() if n >= 4 and 2 * n > len({*map(frozenset, short)}) and w not in named}
    items = [words for _, words, ended in kept if not ended and len(words) < 12]
    items_from = 2 if len(items) >= ITEMS and shuffled(items, 2) else again_from
    drawn = 0
    for size, words, ended in kept:
        n = len(words)
        if ended:
            again = sum(w in keywords for w in words) if n <= PHRASE else 0
            around = sum(seen[w] >= 3 for w in words) if 2 <= n <= SHORT and not central.isdisjoint(words) else 0
            hit = (again >= 2 and again >= MOST * n) or (around >= 2 and 2 * around > n)
        else:
            again = sum(seen[w] >= (items_from if n < 12 else 2) for w in words)
            hit = again * 2 > n and (n < 12 or again >= 0.6 * n) or (n <= 4 and max(seen[w] for w in words) >= 4)
        if hit:
            drawn += size
    return drawn


def _standing(phrases: list[list[str]]) -> Counter:
    """In how many different phrases each word that is no number stands."""
    return Counter(w for p in {*map(frozenset, phrases)} for w in p if not w.isdigit())


def shuffled(phrases: list[list[str]], again_from: int) -> bool:
    """Whether words that come again stand in ever other company."""
    own, after = Counter(w for p in phrases for w in p), defaultdict(set)
    for p in phrases:
        for w, x in zip(p, [*p[1:], ""], strict=True):
            after[w].add(x)
    again = [w for w, n in own.items() if n >= again_from]
    pairs = sum(len(x - {""}) for x in after.values())
    return bool(again) and (pairs >= max(PAIRS, PAIRS_ROOT * own.total() ** 0.5) * len(own) or sum(len(after[w]) / own[w] for w in again) >= AFTER * len(again))


def language(lang: str | None) -> str:
    """The first two letters of a language tag, '' if it has none."""
    found = (lang or "").strip().lower()[:2]
    return found if len(found) == 2 and found.isascii() and found.isalpha() else ""


def step(size: int) -> int:
    """Length class of a block: half steps of the binary logarithm."""
    return int(2 * math.log2(size + 1))


Usual = dict[tuple[str, int], float]


def usual_ratios(docs: DataFrame) -> Usual:
    """The ratio from which a block is redundant, by language and length class.

    Median and spread (between quartiles) are of pages, each of which has one vote (its mean)
    for a length class.  Language '*' stands for all.  There are at most 678 languages and 20
    length classes (no block is longer than 4/3 BLOCK + 80), so the result is small whatever
    the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                votes = defaultdict(list)
                for size, _, ratio, _ in ratios(text or ""):
                    votes[step(size)].append(ratio)
                own = language(lang)
                seen.update((own, k, min(int(sum(v) / len(v) * BINS), 2 * BINS)) for k, v in votes.items())
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["lang", "step", "bin", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, step int, bin int, n bigint").groupBy("lang", "step", "bin").agg(F.sum("n").alias("n"))
    both = counted.unionByName(counted.withColumn("lang", F.lit("*"))).groupBy("lang", "step", "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("lang", "step").orderBy("bin")
    run_up = both.withColumn("upto", F.sum("n").over(upto)).withColumn("every", F.sum("n").over(Window.partitionBy("lang", "step")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("every"), F.col("bin"))) / BINS
    rows = run_up.groupBy("lang", "step", "every").agg(at(0.25).alias("low"), at(0.5).alias("median"), at(0.75).alias("high")).where(F.col("every") >= ENOUGH).collect()
    return {(r.lang, r.step): r.median - REDUNDANT * max(r.high - r.low, 0.02) for r in rows}


def candidate(text: str, lang: str, usual: Usual) -> bool:
    """Whether enough of a page lies in blocks that are redundant and say hardly anything."""
    found = ratios(text)
    enough = SUSPECT * len(text)
    low = [ratio < usual.get((lang, step(size)), usual.get(("*", step(size)), UNKNOWN)) for size, _, ratio, _ in found]
    if not text or sum(size for (size, *_), hit in zip(found, low, strict=True) if hit) < enough:
        return False
    return sum(size for (size, *_), hit, held in zip(found, low, telling(found), strict=True) if hit and held < HELD) >= enough


def searcher_pages(docs: DataFrame) -> DataFrame:
    """doc_id and share of the pages of which more than half is there to draw searchers.

    Null, empty and blank texts aren't cases.  Each row is judged, repeated ones too; a
    null title names no page, a null language counts as unknown; an empty table gives no
    rows.  Other columns aren't read.
    """
    usual = usual_ratios(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, titles = (b.column(c).to_pylist() for c in ("text", "lang", "title"))
            shares = [drawing_share(text, title) if text and candidate(text, language(lang), usual) else 0.0 for text, lang, title in zip(texts, langs, titles, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shares, pa.float64())], names=["doc_id", "share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "title", "text").mapInArrow(run, f"doc_id {kind}, share double").where(F.col("share") > SHARE)
