"""What an answer is in relation to its question: empty, a refusal, a copy, in another language."""

from __future__ import annotations

import re
import unicodedata

_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_WORD = re.compile(r"[㐀-鿿豈-﫿぀-ヿ]|(?:(?![㐀-鿿豈-﫿぀-ヿ])[^\W_])+")
_MARKUP = re.compile(r"</?[A-Za-z][\w-]*[^<>]*>|\\(?:boxed|fbox|text)\b|```\w*|^\W*(?:final\s+)?(?:answer|antwort|réponse|respuesta|答案)\s*[:：]", re.IGNORECASE)
#: Words that stand for an absent answer.
_PLACEHOLDER = frozenset(
    ["", "null", "none", "nil", "nan", "na", "n a", "no answer", "no response", "no output", "empty", "blank", "undefined", "unknown", "tbd", "todo", "answer", "response"]
    + ["keine antwort", "leer", "sin respuesta", "vacío", "sans réponse", "pas de réponse", "vide", "无", "空", "无 答 案"]
)


def words(text: str) -> list[str]:
    """Case-folded runs of letters and digits after compatibility normalisation; each CJK character is a word."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return _WORD.findall(text.casefold())


_LONGEST_PLACEHOLDER = max(x.count(" ") + 1 for x in _PLACEHOLDER)


def is_empty(answer: str | None) -> bool:
    """Null, blank, a placeholder, or mark-up around nothing, however long."""
    if answer is None:
        return True
    # a start without any mark-up that holds more words than a placeholder settles it
    start = answer[:160]
    if "<" not in start and "\\" not in start and "`" not in start and len(words(start)) > _LONGEST_PLACEHOLDER + 3:
        return False
    return " ".join(words(_MARKUP.sub(" ", answer))) in _PLACEHOLDER


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, in one pass over ``b`` with a bit for each word of ``a``."""
    at: dict[str, int] = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for word in b:
        kept = row & at.get(word, 0)
        row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


#: Refusals as they are worded, without opening and closing courtesies; a star stands for the thing refused.
_REFUSALS = [
    (words(x.replace("*", " ")), "*" in x)
    for x in (
        "i can't help with that request", "i cannot help with this", "i can't assist with that", "i'm not able to help with that", "i'm unable to assist with questions about a *", "i am not able to work on this *",
        "i won't provide a solution here", "i won't be able to answer this", "i cannot answer this question", "i can't answer that", "i cannot fulfil this request", "i can't comply with this request", "i cannot provide an answer to that",
        "i do not have permission to discuss the *", "i am not allowed to discuss *", "answering this would go against my guidelines", "this is something i have to leave unanswered", "i must decline to answer", "i have to decline this request",
        "dabei kann ich nicht helfen", "diese anfrage darf ich nicht beantworten", "diese frage kann ich nicht beantworten", "ich muss das ablehnen", "das kann ich leider nicht beantworten", "dazu darf ich nichts sagen", "ich kann dir dabei nicht helfen",
        "je ne peux pas aider avec cette demande", "je ne peux pas répondre à cette question", "il ne m'est pas permis d'en parler", "je dois refuser cette demande", "je dois décliner", "je ne suis pas en mesure de répondre",
        "no puedo ayudar con esa petición", "no puedo responder a esa pregunta", "no me está permitido hablar de ello", "debo negarme a ello", "debo negarme a responder", "tengo que rechazar esta petición",
        "我不能回答这个问题", "我必须拒绝这个要求", "我无法协助处理这个请求", "我无法回答这个问题", "我不能提供帮助", "恕我不能回答",
        "i will not answer this question", "i refuse to answer", "i would rather not say anything on this", "i'd rather not discuss this", "i prefer not to answer this", "i do not wish to comment on this", "i don't feel comfortable answering this",
        "i'm not comfortable discussing *", "that falls outside what i am prepared to discuss", "this falls outside of what i can do", "this is not something i can help with", "i am not permitted to answer this", "i'm not going to answer this question", "no comment on this",
        "i must decline this request", "i respectfully decline to answer", "my guidelines do not allow me to answer this", "i have been instructed not to discuss *", "it would be inappropriate for me to answer this", "you will have to ask someone else about this",
        "darauf möchte ich nicht antworten", "ich werde diese frage nicht beantworten", "darüber darf ich nicht sprechen", "je préfère ne pas répondre à cette question", "je ne répondrai pas à cette question", "prefiero no responder a esta pregunta", "no voy a responder a esta pregunta",
        "non posso aiutarti con questa richiesta", "non posso rispondere a questa domanda", "não posso ajudar com esse pedido", "não posso responder a essa pergunta", "daar kan ik niet mee helpen", "ik kan deze vraag niet beantwoorden",
        "nie mogę w tym pomóc", "nie mogę odpowiedzieć na to pytanie", "я не могу помочь с этим", "я не могу ответить на этот вопрос", "申し訳ありませんがお答えできません", "その質問にはお答えできません",
    )
]
#: Openings and closings that go with a refusal, by which nothing is answered.
_COURTESIES = [
    words(x)
    for x in (
        "i'm sorry but", "sorry but", "apologies", "unfortunately", "regrettably", "i must decline", "as a language model", "as an ai", "as an ai language model", "i appreciate the question however", "at this time",
        "please ask someone qualified instead", "is there anything else you would like to talk about", "let me know if i can support you with another topic",
        "es tut mir leid aber", "leider gilt", "leider", "gern helfe ich bei einem anderen thema", "bitte wende dich an eine fachkraft",
        "toutes mes excuses", "je suis désolé mais", "malheureusement", "merci de demander à quelqu'un d'autre", "puis-je vous aider sur un autre sujet", "je peux aider sur un autre sujet",
        "lo siento pero", "por desgracia", "mis disculpas", "consulta a otra persona por favor", "puedo ayudarte con otro tema",
        "对不起", "很遗憾", "抱歉", "请咨询专业人士", "你可以换一个话题",
    )
]
_RESULT = re.compile(r"####|\\boxed|\\fbox|```|<answer>")
_SENTENCES = re.compile(r"[.!?:;。！？：；\n]+")
#: Least share of a refusal's words that a clause has in their order, words that it may add, words that the rest of the answer may
#: have (an apology, an offer; a reason has no result), and least likeness to a courtesy.
ALIGNED, ADDED, REST, COURTEOUS = 0.85, 12, 16, 0.7
_HOLDERS: dict[str, list[int]] = {}
for _i, (_template, _) in enumerate(_REFUSALS):
    for _word in set(_template):
        _HOLDERS.setdefault(_word, []).append(_i)


def refuses(clause: list[str]) -> bool:
    """Whether a clause aligns with a refusal: nearly all of its words, in their order, and few others."""
    held: dict[int, int] = {}
    for word in set(clause):
        for i in _HOLDERS.get(word, ()):
            held[i] = held.get(i, 0) + 1
    for i, n in held.items():
        template, open_ended = _REFUSALS[i]
        if n >= ALIGNED * len(set(template)) - 1 and (common := longest_common(template, clause)) >= ALIGNED * len(template) and len(clause) - common - 4 * open_ended <= ADDED:
            return True
    return False


_COURTESY_SETS = [(c, frozenset(c)) for c in _COURTESIES]


def is_courtesy(clause: list[str]) -> bool:
    n, own = len(clause), set(clause)
    for courtesy, distinct in _COURTESY_SETS:
        least = COURTEOUS * max(len(courtesy), n)
        if min(len(courtesy), n) >= least and (own & distinct) and longest_common(courtesy, clause) >= least:
            return True
    return False


def is_refusal(answer: str) -> bool:
    """Some clause aligns with a refusal and the others hold no answer: courtesies aside, at most ``REST`` words without a
    result or an equation. An apology or a limited "can't" before a solution is none. Clauses are read until the rest is too
    long, whatever the answer's length."""
    refused, rest = False, 0
    for raw in _SENTENCES.split(answer):
        clause = words(raw)
        if not clause:
            continue
        if refuses(clause):
            refused = True
        elif not is_courtesy(clause):
            rest += len(clause)
            if rest > REST or "=" in raw:
                return False
    return refused and not _RESULT.search(answer)


def is_copy(question: str, answer: str) -> bool:
    """The answer consists of the question: three-word shingles of the answer lie in the question, and the two align over
    most of the answer and of the question (an instruction after the question may be left out). A question given back
    more than once aligns with its repetition."""
    a = words(answer)
    if len(a) < 4:
        return False
    q = words(question)
    known = set(q)
    if sum(w in known for w in a) < 0.8 * len(a) or len(a) < 0.3 * len(q):
        return False
    shingles = set(zip(a, a[1:], a[2:]))
    if len(shingles & set(zip(q, q[1:], q[2:]))) < 0.6 * len(shingles):
        return False
    common = longest_common(q, a)
    if common < 0.3 * len(q):
        return False
    return common >= 0.85 * len(a) or len(a) > common and longest_common(q * (1 + 2 * len(a) // len(q)), a) >= 0.9 * len(a)


#: Frequent words that tell languages of one script apart.
_COMMON = {
    "en": frozenset("the of and is that it to from with which if we by at so this be are its when because only not what how why does then every each both next these into over was".split()),
    "de": frozenset("der die das und ist von wir mit bei wenn also ein eine nicht im den bevor zu warum wie für auf werden bleibt daraus einen dem des aber dann nur aus".split()),
    "fr": frozenset("le la les un une et des est puis donc si chez dans par du pour avant que reste alors pourquoi combien on en ce cette aux avec sur mais".split()),
    "es": frozenset("el los las un una y del es si por en con para entonces luego cuando que queda antes al cada cuánto qué junto sale pero muy como esta este".split()),
    "it": frozenset("il gli che di della delle dei sono nel nella alla è quindi poi dal dalla questo questa anche ogni più perché si così cosa".split()),
    "pt": frozenset("não uma os das dos ao são então pelo pela também até você isso essa esse é foi mais cada quando fica".split()),
    "nl": frozenset("het een van niet zijn dat voor wordt ook maar naar bij aan dus deze worden heeft elke daarna blijft".split()),
    "pl": frozenset("jest nie się że jak więc dla przez oraz tego który która ale tylko jeśli każdy są z na do".split()),
    "sv": frozenset("och är att det som inte för på av den till har varje sedan eller blir detta".split()),
    "tr": frozenset("ve bir bu için ile değil daha çok olarak sonra her olan ise gibi".split()),
}
_ALL_COMMON = frozenset().union(*_COMMON.values())
_CJK = re.compile(r"[㐀-鿿]")
#: Scripts that tell a language (or a few) by themselves.
_SCRIPTS = {
    "kana": re.compile(r"[\u3041-\u30ff]"),
    "hangul": re.compile(r"[\uac00-\ud7af\u1100-\u11ff]"),
    "cyrillic": re.compile(r"[\u0400-\u052f]"),
    "arabic": re.compile(r"[\u0620-\u06ff]"),
    "hebrew": re.compile(r"[\u05d0-\u05ea]"),
    "devanagari": re.compile(r"[\u0904-\u097f]"),
    "bengali": re.compile(r"[\u0985-\u09b9]"),
    "thai": re.compile(r"[\u0e01-\u0e5b]"),
    "greek": re.compile(r"[\u0370-\u03ff\u1f00-\u1fff]{3}"),
}
_NOT_PROSE = re.compile(r"```.*?(?:```|\Z)|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]|\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|<[^<>]*>", re.DOTALL)
#: The languages' names, in these languages.
_NAMES = {
    "en": "english|englisch(?:er)?|anglais|inglés|英语|英文",
    "de": "german|deutsch(?:er)?|allemand|alemán|德语|德文",
    "fr": "french|französisch(?:er)?|français|francés|法语|法文",
    "es": "spanish|spanisch(?:er)?|espagnol|español|castellano|西班牙语|西班牙文",
    "it": "italian|italienisch(?:er)?|italien|italiano|意大利语",
    "pt": "portuguese|portugiesisch(?:er)?|portugais|portugués|português|葡萄牙语",
    "nl": "dutch|niederländisch(?:er)?|néerlandais|neerlandés|nederlands|荷兰语",
    "pl": "polish|polnisch(?:er)?|polonais|polaco|polski|波兰语",
    "sv": "swedish|schwedisch(?:er)?|suédois|sueco|svenska|瑞典语",
    "tr": "turkish|türkisch(?:er)?|turc|turco|türkçe|土耳其语",
    "kana": "japanese|japanisch(?:er)?|japonais|japonés|日本語|日语|日文",
    "hangul": "korean|koreanisch(?:er)?|coréen|coreano|한국어|韩语",
    "cyrillic": "russian|russisch(?:er)?|russe|ruso|русский|俄语|ukrainian|bulgarian|serbian",
    "arabic": "arabic|arabisch(?:er)?|arabe|árabe|阿拉伯语|persian|farsi|urdu",
    "hebrew": "hebrew|hebräisch(?:er)?|hébreu|hebreo|希伯来语",
    "devanagari": "hindi|marathi|nepali|sanskrit|印地语",
    "bengali": "bengali|bangla|孟加拉语",
    "thai": "thai|thailändisch(?:er)?|thaï|tailandés|泰语",
    "greek": "greek|griechisch(?:er)?|grec|griego|希腊语",
    "zh": "chinese|chinesisch(?:er)?|chinois|chino|中文|汉语|mandarin",
}
_ASKED = {
    code: re.compile(rf"\b(?:in|into|to|auf|en|ins|au|al)\s+(?:{names})\b|\b(?:{names})\s*,?\s*(?:please|bitte|s'il|por favor|only|version|translation)|(?:please|bitte|use|only)\W+(?:\w+\W+){{0,3}}(?:{names})\b|(?:用|以|译成|翻译成)\s*(?:{names})", re.IGNORECASE)
    for code, names in _NAMES.items()
}


def script_of(text: str) -> str | None:
    """The script other than Latin and Han that most letters of ``text`` are in; None if there is none."""
    if text.isascii():
        return None
    best = max(_SCRIPTS, key=lambda name: len(found[name]) if name in found else 0) if (found := {name: own for name, pattern in _SCRIPTS.items() if (own := pattern.findall(text))}) else None
    if best is None:
        return None
    letters = sum(map(str.isalpha, text))
    n = sum(map(len, found[best]))
    return best if n > (0.15 if best == "kana" else 0.5) * letters else None


def language_hits(text: str) -> dict[str, int]:
    seen = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if w in _ALL_COMMON]
    hits = {code: sum(w in own for w in seen) for code, own in _COMMON.items()}
    hits["zh"] = len(_CJK.findall(text)) // 2
    return hits


def main_language(text: str) -> str | None:
    """The language of the prose of ``text``, leaving out quotations, code and formulas; None if nothing tells."""
    prose = _NOT_PROSE.sub(" ", text)
    if (script := script_of(prose)) is not None:
        return script if sum(map(str.isalpha, prose)) >= 8 else None
    hits = language_hits(prose)
    best = max(hits, key=hits.get)
    others = max(v for k, v in hits.items() if k != best)
    return best if hits[best] >= 3 and hits[best] > 1.5 * others else None


def quick_language(distinct: set[str], text: str) -> str:
    """The likely language from the distinct blank-separated words alone; used to pass over pairs that clearly agree."""
    seen = distinct & _ALL_COMMON
    best = max(_COMMON, key=lambda code: len(seen & _COMMON[code]))
    n = len(seen & _COMMON[best])
    if not text.isascii():
        if len(_CJK.findall(text)) > 2 * n:
            return script_of(text) or "zh"
        if n < 3 and (script := script_of(text)) is not None:
            return script
    return best if n else ""


def is_other_language(question: str, answer: str) -> bool:
    """The answer's prose is in another language than the question's, and the question doesn't ask for that language."""
    if quick_language(set(question.lower().split()), question) == quick_language(set(answer.lower().split()), answer):
        return False
    to = main_language(answer)
    if to is None:
        return False
    asked = main_language(question)
    return asked is not None and to != asked and not _ASKED[to].search(question)
