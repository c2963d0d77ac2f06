"""What a page is made of. Features for a classifier: how its words lie in prose, lists of links, strings of keywords, lists
of tags or products, and matter such as code, logs, tables and headings, and how much they repeat. Signals for weak labels,
none of which is a feature: how many different function words a page has for its length, the share of its characters in
anchors and in figures, how well it compresses, and the share of its lines that end in a price."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log1p, sqrt

#: Frequent words of sentences in several languages.
FUNCTION_WORDS = frozenset(
    (
        "the of and is a an that in it to from with its which if so we by at as this be are was when because cannot can only not into over then both each every since until whether how what why or on their them they he she his her has have had but than"
        " der die das und ist von wir mit bei wenn ein eine einen nicht im den dem des bevor zu wie für auf werden bleibt daraus also aus durch erhalten"
        " le la les un une et des est puis donc si chez dans par du avant que reste en au aux pour sur on ce cette alors chaque"
        " el los las y del es por con para entonces luego cuando cada queda antes al cuenta vale una junto sale"
    ).split()
)
_LINK = re.compile(r"://|www\.|href=|\]\(|\b[\w-]+\.[a-z]{2,8}/", re.IGNORECASE)
_LOG = re.compile(r"^\W{0,2}(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b|(?:step|epoch|iter)\w*\W{0,2}\d)|(?:[\w/]+[:=]-?\d[\d.e-]*\W+){2}", re.IGNORECASE)
_CODE = re.compile(r"^\s*(?:def |class |for .*:$|if .*:$|while .*:$|else:|try:|return\b|import |from \w+ import|[\w.\[\]]+ [-+*/]?= |[{}();]+$|//|/\*|#include)")
_TAG_LABEL = re.compile(r"^\W{0,3}(?:tags?|topics?|labels?|filed under|keywords?|categor(?:y|ies)|stichwörter|schlagwörter|mots[- ]clés|étiquettes|etiquetas|palabras clave|标签|关键词)\s*[:：]", re.IGNORECASE)
_CJK = re.compile(r"[㐀-鿿]")
_CJK_SENTENCE = re.compile(r"[，。；！？]")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_ANCHOR = re.compile(r"<a\b.*?</a>", re.DOTALL | re.IGNORECASE)
_DOMAIN = re.compile(r"\W{0,3}[\w-]+(?:\.[\w-]+)+/")
_PRICE = re.compile(r"(?:^|[^\w.,])\d{1,9}[.,]\d\d\W{0,4}$")
_PRICED_WORDS = re.compile(r"(?:^|\s)[^\W\d_]{2,}(?=\s)")
#: Frequent characters of Chinese sentences.
_CJK_FUNCTION = frozenset("的是了在和把从到与之其因由使将被若则而但即也只就再已")
_NUMBER = re.compile(r"^[-+$€%]*\d[\d.,%]*$")

PROSE, MATTER, LINKS, KEYWORDS, TAGS, PRODUCTS, SHORT = range(7)
#: Names of the features in the order of ``page_features``.
NAMES = ("links", "keywords", "tags", "products", "prose", "matter", "distinct", "link_words", "hash_words", "separators", "words_per_line", "log_words", "repeated", "repeated_pairs")
#: Names of the signals in the order of ``page_signals``; the other is ``compressed``.
SIGNALS = ("function_variety", "anchors", "figures", "priced")
_FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)
_TO_SPACES = bytes(32 if c in b'.,;:!?()"' else c for c in range(256))
_FIGURES = b"0123456789{}()[]=<>+*/\\$_"


def _is_anchor(piece: str) -> bool:
    return "://" in piece or "](" in piece or piece[:4].lower() == "www." or "/" in piece and _DOMAIN.match(piece) is not None


def page_signals(text: str) -> list[float]:
    """The signals named in ``SIGNALS``. ``function_variety`` is the number of different function words by the square root
    of the number of words, where two Chinese characters count as a word; ``anchors`` a share of pieces, ``figures`` of
    characters, ``priced`` of lines."""
    pieces = text.split()
    n_words, variety = len(pieces), len(_FUNCTION_BYTES.intersection(text.lower().encode("utf-8", "replace").translate(_TO_SPACES).split()))
    if not text.isascii() and (chinese := len(_CJK.findall(text))):
        n_words, variety = max(n_words, chinese // 2), variety + len(_CJK_FUNCTION.intersection(text))
    within, rest = 0, pieces
    if "</a>" in text:
        within = sum(len(tag.split()) for tag in _ANCHOR.findall(text))
        rest = _ANCHOR.sub(" ", text).split()
    if "/" in text or "](" in text or "www." in text:
        kept = [w for w in rest if not _is_anchor(w)]
        within, rest = within + len(rest) - len(kept), kept
    share = within / (within + sum(not w.isascii() or any(map(str.isalnum, w)) for w in rest)) if within else 0.0
    plain = "".join(rest)
    raw = plain.encode("utf-8", "replace")
    figures = (len(raw) - len(raw.translate(None, _FIGURES))) / max(1, len(plain))
    lines = [line for line in text.split("\n") if line.strip()]
    priced = sum(bool(_PRICE.search(line[-20:])) and len(_PRICED_WORDS.findall(line[:200])) >= 3 for line in lines)
    return [variety / sqrt(max(1, n_words)), share, figures, priced / max(1, len(lines))]


def compressed(text: str) -> float:
    """Bytes of the compressed text by those of the text."""
    raw = text.encode("utf-8", "replace")
    return len(zlib.compress(raw, 1)) / max(1, len(raw))


def kind_of(line: str, words: list[str], functions: int) -> int:
    """What a line outside of code fences is; ``functions``: its function words."""
    n = len(words)
    share = functions / n
    first = line.lstrip()[:1]
    if _LINK.search(line):
        return LINKS if share < 0.2 else PROSE
    if first == "#" and line.lstrip().lstrip("#")[:1] == " " and n <= 14:
        return MATTER  # heading
    if first == "|":
        return MATTER  # table
    if share >= 0.12 and n >= 4:
        if n >= 15 and len(FUNCTION_WORDS.intersection(words)) <= 2:
            return KEYWORDS  # the same one or two over and over: a phrase that holds them is repeated
        if functions >= 2 or share >= 0.2 or len(set(words)) > 0.7 * n:
            return PROSE
    if words[0][0] == "#" and sum(w[0] == "#" for w in words) > 0.6 * n:
        return KEYWORDS
    bars = line.count(" | ")
    if bars >= 2:
        cells = [c.strip() for c in line.split("|")]
        numbers = sum(bool(_NUMBER.match(c)) for c in cells)
        return MATTER if numbers >= 0.5 * len(cells) else PRODUCTS if numbers else KEYWORDS
    if _LOG.search(line) or _CODE.search(line):
        return MATTER
    if _TAG_LABEL.search(line):
        return TAGS
    cjk = 0 if line.isascii() else len(_CJK.findall(line))
    if cjk > 0.3 * len(line):
        if _CJK_SENTENCE.search(line) and max(map(len, words)) > 12:
            return PROSE
        return KEYWORDS if n >= 4 else SHORT
    if n <= 5:
        return MATTER if line.rstrip()[-1:] in ":：" or any(c.isdigit() for c in line) or first in "<#$" else SHORT
    if n < 12 and share >= 0.08 and len(set(words)) > 0.8 * n:
        return PROSE
    return KEYWORDS


def is_sentence(words: list[str]) -> bool:
    """Whether the words read as a sentence: several different function words, or one among few words that don't repeat."""
    different = len(FUNCTION_WORDS.intersection(words))
    n = len(words)
    varied = len(set(words)) > 0.7 * n
    if different >= 3 or different == 2 and (n < 15 or varied):
        return True
    return different == 1 and n < 20 and varied


def page_features(text: str) -> tuple[int, list[float]]:
    """Number of blank-separated words, and the features named in ``NAMES``."""
    counts = [0] * 7
    fenced = False
    link_words = hash_words = separators = lines = short_lines = 0
    seen: Counter[str] = Counter()
    pairs: set[tuple[str, str]] = set()
    total = n_pairs = 0
    for line in text.split("\n"):
        words = line.lower().split()
        if not words:
            continue
        n = len(words)
        total += n
        lines += 1
        if line.lstrip()[:3] == "```":
            counts[MATTER] += n
            if line.count("```") % 2:
                fenced = not fenced
            continue
        if fenced:
            counts[MATTER] += n
            continue
        seen.update(words)
        pairs.update(zip(words, words[1:]))
        n_pairs += n - 1
        functions = sum(map(FUNCTION_WORDS.__contains__, words))
        kind = kind_of(line, words, functions)
        if kind == PROSE and n > 30 and functions < 0.22 * n or kind == KEYWORDS and n > 14 and functions:
            # a line of both: by its sentences
            for sentence in _SENTENCES.split(line):
                own = sentence.lower().split()
                if own:
                    counts[PROSE if is_sentence(own) else KEYWORDS if kind == KEYWORDS else kind_of(sentence, own, sum(map(FUNCTION_WORDS.__contains__, own)))] += len(own)
        else:
            counts[kind] += n
        if kind == SHORT:
            short_lines += 1
        if kind == LINKS:
            link_words += sum(bool(_LINK.search(w)) for w in words)
        if kind != PROSE:
            hash_words += sum(w[0] == "#" for w in words)
            separators += sum(w in ("-", "|", "/", "»", "*", "·", "•") for w in words) + line.count(",")
    if short_lines >= 5:  # a list of keywords by lines
        counts[KEYWORDS] += counts[SHORT]
    elif counts[SHORT]:
        counts[MATTER] += counts[SHORT]
    if not total:
        return 0, [0.0] * len(NAMES)
    share = [counts[k] / total for k in (LINKS, KEYWORDS, TAGS, PRODUCTS, PROSE, MATTER)]
    outside = max(1, seen.total())  # words outside of code fences
    rest = [len(seen) / outside, link_words / total, hash_words / total, separators / total, total / lines, log1p(total)]
    return total, share + rest + [max(seen.values(), default=0) / outside, 1 - len(pairs) / max(1, n_pairs) if n_pairs else 0.0]
