"""Problem 1: personal data inside free text, replaced by typed placeholders.

Transducers rewrite a text and keep for each character of the result the span of the source it stands for: grapheme clusters take
their plain form (looks.py) and digits of all scripts become ASCII; digit words in a row become digits; disguises of "@" and "."
in addresses become the signs. Identifiers are found in the rewritten text, and their spans are mapped back, so the rest of the
source stays as it was, down to the character.

Types: EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME. Names are found where words introduce one, after titles and in contexts of persons, in
contexts learned from all the texts themselves (class Cues), where a given name and a surname of the gazetteer meet, and as items in
a row of personal data; words of shops and buildings beside them rule them out.

A null text stays null and holds nothing, as a blank one; repeated rows count once; a gazetteer may be empty. The gazetteer is a small
table that doesn't grow with the texts; its size is checked before it's sent to the executors.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakya.llm.base import check_broadcast, deep_size, not_blank, release, table, word_pattern, written
from vakya.llm.looks import both_texts, transducer

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Words for digits: English and romanised words, then hi, mr, te, ta, kn, ml, bn, gu, pa, ur. All native words are in the plain form.
DIGITS_OF = """zero oh shunya sunna poojyam sonne shunno sifar|one ek okati onru ondru ondu onnu ik|two do rendu don irandu eradu randu dui be|three teen moodu moonru moondru mooru moonnu tin tran|four char nalugu naangu nangu naalku naalu chaar|five paanch aidu pach ainthu aindhu anchu panch panj|six chhe aaru saha choy chhoy chha chhah|seven saat edu ezhu elu shat satt|eight aath enimidi ettu entu aat atth|nine nau tommidi onbathu onbadhu ombattu onpathu ombathu noy nav naun
शून्य|एक|दो|तीन|चार|पांच पाँच|छह छः छे|सात|आठ|नौ
शून्य|एक|दोन|तीन|चार|पाच|सहा|सात|आठ|नऊ
సున్నా సున్న|ఒకటి|రెండు|మూడు|నాలుగు|ఐదు|ఆరు|ఏడు|ఎనిమిది|తొమ్మిది
பூஜ்ஜியம் பூஜ்யம் சுழியம்|ஒன்று|இரண்டு|மூன்று|நான்கு நாலு|ஐந்து|ஆறு|ஏழு|எட்டு|ஒன்பது
ಸೊನ್ನೆ|ಒಂದು|ಎರಡು|ಮೂರು|ನಾಲ್ಕು|ಐದು|ಆರು|ಏಳು|ಎಂಟು|ಒಂಬತ್ತು
പൂജ്യം|ഒന്ന്|രണ്ട്|മൂന്ന്|നാല്|അഞ്ച്|ആറ്|ഏഴ്|എട്ട്|ഒമ്പത് ഒൻപത്
শূন্য|এক|দুই|তিন|চার|পাঁচ|ছয়|সাত|আট|নয়
શૂન્ય|એક|બે|ત્રણ|ચાર|પાંચ|છ|સાત|આઠ|નવ
ਸਿਫ਼ਰ ਜ਼ੀਰੋ|ਇੱਕ ਇਕ|ਦੋ|ਤਿੰਨ|ਚਾਰ|ਪੰਜ|ਛੇ|ਸੱਤ|ਅੱਠ|ਨੌਂ ਨੌ
صفر|ایک|دو|تین|چار|پانچ|چھ چھے|سات|آٹھ|نو"""
DIGIT_WORDS = {w: d for line in unicodedata.normalize("NFKC", DIGITS_OF).split("\n") for d, ws in zip("0123456789", line.split("|")) for w in ws.split()}
STREETS = "street road lane avenue marg gali veedhi path chowk"
# Further words for houses, "number" and streets in native script and romanised; such a street counts only after a house.
HOUSES_OF = "मकान घर फ्लैट फ्लॅट प्लॉट दरवाजा ఇంటి ఇల్లు గడప డోర్ ఫ్లాట్ ప్లాట్ வீட்டு வீடு கதவு மனை பிளாட் ಮನೆ ಬಾಗಿಲು ಫ್ಲಾಟ್ ಪ್ಲಾಟ್ വീട്ടു വീട് ഫ്ലാറ്റ് പ്ലോട്ട് বাড়ি বাসা ফ্ল্যাট প্লট મકાન ઘર ફ્લેટ પ્લોટ ਮਕਾਨ ਘਰ ਫਲੈਟ ਪਲਾਟ مکان گھر فلیٹ پلاٹ makaan ghar inti gadapa veettu kathavu mane veedu veettu bari house door flat plot makan"
NUMBERS_OF = "नंबर नम्बर नं क्रमांक संख्या क्र నంబర్ నెంబర్ నం సంఖ్య எண் நம்பர் ಸಂಖ್ಯೆ ನಂಬರ್ ನಂ നമ്പർ നമ്പര് നം নম্বর নং নাম্বার નંબર નં ક્રમાંક ਨੰਬਰ ਨੰ نمبر number nambar nombor no nam en sankhye kramank"
STREETS_OF = "गली गल्ली सड़क रस्ता मार्ग रोड पथ चौक स्ट्रीट लेन వీధి రోడ్డు రోడ్ మార్గం లేన్ స్ట్రీట్ தெரு சாலை வீதி ரோடு சந்து ಬೀದಿ ರಸ್ತೆ ಮಾರ್ಗ ರೋಡ್ ಓಣಿ തെരുവ് റോഡ് ലെയ്ൻ വഴി সড়ক রোড গলি লেন রাস্তা সরণি શેરી રોડ માર્ગ ગલી રસ્તો ਗਲੀ ਸੜਕ ਰੋਡ ਮਾਰਗ گلی سڑک روڈ شارع galli sadak rasta rasthe raste theru salai saalai veedi veethi beedi theruvu sarani sheri"
SHOPS = "medicals medical stores store traders textiles hospital clinic school college apartments apartment towers tower complex bhavan nagar hotel mart bakery signboard shop bank hall theatre temple colony residency enclave"
# Words that introduce a name, or a neighbour's, in the languages, as before|after.
PHRASES = """my name is|
name\\s*[:=]|
signed by|
i am called|
this is|speaking
mera naam|hai
naa peru|andi
मेरा नाम|है
माझे नाव|आहे
నా పేరు|అండి
नाम\\s*[:=]|
नाव\\s*[:=]|
పేరు\\s*[:=]|
பெயர்\\s*[:=]|
ಹೆಸರು\\s*[:=]|
പേര്\\s*[:=]|
নাম\\s*[:=]|
નામ\\s*[:=]|
ਨਾਂ\\s*[:=]|
ਨਾਮ\\s*[:=]|
نام\\s*[:=]|
माझं नाव|आहे
என் பெயர்|
எனது பெயர்|
ನನ್ನ ಹೆಸರು|
എന്റെ പേര്|
আমার নাম|
મારું નામ|છે
ਮੇਰਾ ਨਾਂ|ਹੈ
ਮੇਰਾ ਨਾਮ|ਹੈ
میرا نام|ہے
maz(?:h)?a naav|aahe
majhe naav|aahe
hamare padosi|bhi
maa pakkinti|kuda
हमारे पड़ोसी|भी
మా పక్కింటి|కూడా
आमचे शेजारी|सुद्धा
எங்கள் பக்கத்து வீட்டு|கூட
ನಮ್ಮ ಪಕ್ಕದ ಮನೆಯ|ಕೂಡ
ഞങ്ങളുടെ അയൽക്കാരൻ|(?:പോലും|കൂടി)
আমাদের প্রতিবেশী|ও
અમારા પાડોશી|પણ
ਸਾਡੇ ਗੁਆਂਢੀ|ਵੀ
ہمارے پڑوسی|بھی
en peyar|
nanna hesaru|
ente peru|
amar naam|
maru naam|(?:chhe|che)
mera naa|hai
mera naan|hai"""
# Contexts of a person in general, as before|after, behind the words one of which they have; a name there is capitalised, and known or of two words.
CONTEXTS = """waited complained says said told died lives works fell got lost been;|(?:waited|complained|says|said|told (?:me|us|them)|died|lives|works|fell (?:ill|sick|down)|got (?:no|nothing|hurt)|lost (?:his|her|their)|has been (?:ill|sick|waiting))
told asked met called know saw;(?:i|we) (?:told|asked|met|called|know|saw)|(?:the|that|about|to|and|at|in|yesterday|today)
contact phone call meet inform reach ask tell thank thanks;(?:contact|phone|call|meet|inform|reach|ask|tell|thank|thanks to)|(?:at|on|in|for|about|to|from|who|and|of|if|before|after|when)
contact phone call meet inform reach ask tell thank thanks met;(?:contact|phone|call|meet|inform|reach|ask for|tell|thank|thanks to|met)|
even;even|from (?:our|my|the)
neighbour neighbor friend brother sister father mother uncle aunt cousin colleague teacher son daughter wife husband;(?:my|our) (?:neighbou?r|friend|brother|sister|father|mother|uncle|aunt|cousin|colleague|teacher|son|daughter|wife|husband)|(?:is|was|has|had|got|waited|said|told|lost|fell|also|and|who)
am m;(?:i am|i'm)|from
yours regards thanks sincerely;(?:yours|regards|thanks|sincerely),|"""
# Words before a name that say so by themselves; the name is as far as capitals go.
TITLES = "mr mrs ms miss dr prof shri sri shree smt sushri kumari".split()

NOT_NAMES = frozenset("my our the a an even i told ask for name is neighbour neighbor mera naam naa peru".split())

# Words that begin a sentence before a name.
LEADING = frozenset("then when but and so also today yesterday now later while because after before since if as yes no well finally here there this that our even poor old".split())

_i = regex.IGNORECASE
_digit = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
SPELLED = regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:(?:{_digit})(?:[ ,-]+|(?![\p{{L}}\p{{M}}]))){{7,}}", _i)
_part = r"[A-Za-z0-9](?:[A-Za-z0-9_-]*[A-Za-z0-9])?"
_local = r"[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?"
_dot = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\.)"
DISGUISED = regex.compile(
    rf"(?<![\w@])({_local})(?:(?:\s?[\[({{<]\s?(?:at|@)\s?[\])}}>]\s?|\s@\s|@)({_part}(?:{_dot}{_part})+)|\sat\s({_part}(?:\sdot\s{_part})+))", _i
)
EMAIL = regex.compile(rf"(?<![\w@./]){_local}@{_part}(?:\.{_part})*\.[A-Za-z]{{2,}}(?!\w)")
_from, _to = r"(?<![\w@#+/-]|\d[.,:])", r"(?![\w@-]|[.,:/]\d)"
PHONE = regex.compile(
    rf"{_from}(?:\(?\+\d{{1,3}}\)?[ .-]?(?:\(\d{{2,4}}\)[ .-]?)?\d{{2,6}}(?:[ .-]?\d{{2,6}}){{1,3}}"
    rf"|\(\d{{3}}\) ?\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|0\d{{4}}-\d{{3}}-\d{{3}}|\d{{5}}-\d{{3}}-\d{{3}}|0?[6-9]\d{{9}}|[6-9]\d{{4}}[ -]\d{{5}}|(?:\d[ .-]){{9}}\d"
    rf"|(?:0[ -]?|91[ -]?)?[6-9](?:(?:[ -]?\d){{9}}|(?:\.?\d){{9}})|(?=(?:\D?\d){{11}}(?!\d))(?:\(0\d{{2,4}}\)|0\d{{2,4}})[ -]?\d{{2,4}}[ -]?\d{{3,4}}){_to}"
)
CARD = regex.compile(rf"{_from}[2-9]\d{{3}}([ -]?)\d{{4}}\1\d{{4}}{_to}")
LETTERED = regex.compile(r"(?<![\w@#/-])(?:[a-z]{5}\d{4}[a-z]|[a-z]{3}/?\d{7}|[a-z] ?\d{7})(?![\w-]|[./]\d)", _i)
OTHER_NUMBER = regex.compile(r"(?:complaint|receipt|transaction|txn|scheme|helpline|ticket|token|order|bill|file no|ref|reading|score|version|invoice|account|tracking|shikayat|firyadu|शिकायत|तक्रार|ఫిర్యాదు|புகார்|ದೂರು|പരാതി|অভিযোগ|ફરિયાદ|ਸ਼ਿਕਾਇਤ|شکایت)\W{0,3}$", _i)
_street = rf"(?:{'|'.join(STREETS.split())})\b"
_any = lambda words: "|".join(sorted({*unicodedata.normalize("NFKC", words).split()}, key=lambda w: (-len(w), w)))
_far_street = rf"(?<![\p{{L}}\p{{M}}])(?:{_any(STREETS_OF)}|{_any(STREETS)})(?:(?<![a-z])[\p{{L}}\p{{M}}]*|(?![\p{{L}}\p{{M}}]))"
_pin = r"(?:[ ,-]*(?:PIN(?: code)?\W{0,2})?\d{3} ?\d{3}\b)"
_town = r"(?:[,،]? *\p{L}[\p{L}\p{M}]*(?: Dist\b)?)"
ADDRESS = regex.compile(
    rf"(?<!\w)(?:(?:h\.? ?no\.?|house(?: no\.?)?|door(?: no\.?)?|d\.? ?no\.?|plot(?: no\.?)?|flat(?: no\.?)?|makan(?: no\.?)?)[ #:]*\d[\w/-]*,? +(?:[\p{{L}}\p{{M}}'.]+,? +){{0,6}}?{_street}(?: behind the [\w ]{{2,14}}?(?=,))?(?:,{_town}{_pin}?|{_town}{_pin})?"
    rf"|(?<![\w/.,:-]|\d )\d{{1,4}}[a-z]?,? +(?:\p{{L}}[\p{{L}}\p{{M}}']* +){{1,3}}?{_street}(?:,{_town}{_pin}?|{_town}{_pin})"
    rf"|(?<![\p{{L}}\p{{M}}])(?:{_any(HOUSES_OF)})(?:[ .]*(?:{_any(NUMBERS_OF)}))?[ .:#-]*\d[\w/-]*[,،]? +(?:[\p{{L}}\p{{M}}'.]+[,،]? +){{0,6}}?{_far_street}(?:[,،]{_town}{_pin}?|{_town}{_pin})?)",
    _i,
)
_token = r"(?:\p{L}\.|\p{L}[\p{L}\p{M}']*)"
_name = rf"{_token}(?: +{_token}){{0,3}}?"
_stop = r"(?=\s*(?:[.!?,;|\n।۔\p{So}#@(]|$|\s\p{L}+\s*[:=]))"
_start = r"(?:^|[.!?;|\n।۔\p{So}>]|(?<=[\p{L}\p{N}]) )\s*"
#: A pattern, what a text that it may match holds (a string, or one of some words), and whether its context is a general one.
NAMED: list[tuple[regex.Pattern, str | frozenset[str], bool]] = []
for _lines, _general in ((PHRASES, False), (CONTEXTS, True)):
    for _line in unicodedata.normalize("NFKC", _lines).split("\n"):
        _hints, _, _line = _line.rpartition(";")
        _before, _, _after = _line.partition("|") if not _general else regex.fullmatch(r"((?:[^|(]|\([^)]*\))*)(\|)(.*)", _line).groups()
        if _before and _after:
            _p = rf"(?<![\p{{L}}\p{{M}}]){_before} +(?<name>{_name}) +{_after}(?![\p{{L}}\p{{M}}])"
        elif _before:
            _p = rf"(?<![\p{{L}}\p{{M}}]){_before}(?![\p{{L}}\p{{M}}]) *(?<name>{_name}){_stop}"
        else:
            _p = rf"{_start}(?<name>{_name}) +{_after}(?![\p{{L}}\p{{M}}])"
        NAMED.append((regex.compile(_p, _i), frozenset(_hints.split()) if _general else (_before or _after).partition("\\")[0].partition("(")[0].strip(), _general))
DIGITS = re.compile(r"[+(]?\d[\d() .+-]{8,}\d")
CODE = re.compile(r"\d{7}|[A-Za-z]{5}\d{4}")
OTHER_DIGIT = re.compile(r"[^\D0-9]")
AT = re.compile(r"[\[({<]\s?(?:at|@)\s?[\])}>]")
SIGN = re.compile(r"[A-Za-z0-9]\s?@\s?[A-Za-z0-9]")
TWO_DIGIT_WORDS = re.compile(rf"(?:{_digit})[ ,-]+(?:{_digit})(?![a-z])")
PAIR = regex.compile(rf"(?:^|[.!?;।۔]\s|\p{{So}}\s*)({_token} (?:\p{{L}}\.? )?{_token})(?=\s*(?:[.!?।۔]+(?:\s|$)|;|$))")
TOKEN = regex.compile(r"(?<![\w@#./-])(\p{L}[\p{L}\p{M}']*)\.?")
ITEM = regex.compile(r"[^;\n|]+")
NAME_ITEM = regex.compile(rf"\s*({_token}(?: {_token}){{1,2}}?)[.!?\s\p{{So}}]*(?:#.*)?", regex.DOTALL)
STREET_WORDS = frozenset(unicodedata.normalize("NFKC", f"{STREETS} {STREETS_OF}").split())
#: For texts in lower case: without a flag for case the search skips to first letters.
HAS_STREET = re.compile("|".join(sorted(STREET_WORDS)))
TITLED = regex.compile(rf"(?<![\w@#])(?i:{'|'.join(TITLES)})\.? +(?<name>\p{{Lu}}[\p{{L}}\p{{M}}']*(?: (?:\p{{Lu}}\.?(?!\w)|\p{{Lu}}[\p{{L}}\p{{M}}']*)){{0,2}})")


_unit = regex.compile(rf"(?<![\w@#])(?:{'|'.join(TITLES)})\.|(?<![\p{{L}}\p{{M}}])\p{{L}}\.(?= ?\p{{L}})|\p{{L}}[\p{{L}}\p{{M}}']*|[.!?;|\n।۔]|\d+|[@_-]", _i)
END = ("$",)


def units(t: str) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end); '$' stands for signs that end a sentence or an item, '#' for numbers and signs within words."""
    return [("#" if w[0].isdigit() or w in "@_-" else w if w[0].isalpha() else "$", m.start(), m.end()) for m in _unit.finditer(t) if (w := m[0].lower())]


def _left(ws: list[str], i: int) -> list[tuple[str, ...]]:
    return [END] if i == 0 or ws[i - 1] == "$" else [(ws[i - 1],)] + ([(ws[i - 2], ws[i - 1])] if i > 1 and ws[i - 2] != "$" else [])


def _right(ws: list[str], j: int) -> list[tuple[str, ...]]:
    """Of the words from j on."""
    if j >= len(ws) or ws[j] == "$":
        return [END]
    out = []
    for k in range(j, min(len(ws), j + 3)):
        if ws[k] == "$":
            break
        out.append(tuple(ws[j : k + 1]))
    return out


_simple = regex.compile(r"\p{L}[\p{L}\p{M}']*|[.!?;|\n।۔]|\d+|[@_-]")
Context = tuple[tuple[str, ...], tuple[str, ...]]


def unit_words(t: str) -> list[str]:
    """The words of `units` without their places: faster where no dot follows a title or a letter, so that dots are signs only."""
    ws = _simple.findall(t)
    if any(b == "." and (len(a) == 1 and a.isalpha() or a.lower() in TITLES) for a, b in zip(ws, ws[1:])):
        return [w for w, *_ in units(t)]
    return [w.lower() if w[0].isalpha() else "#" if w[0].isdigit() or w in "@_-" else "$" for w in ws]


def met(ws: list[str], given: set[str], surnames: set[str]) -> Iterator[tuple[Context, str]]:
    """Contexts that a given name and a surname of the gazetteer stand in, and the name."""
    for i, w in enumerate(ws):
        if w in given or w in surnames:
            j = i + 2 if i + 2 < len(ws) and len(ws[i + 1].strip(".")) == 1 else i + 1
            if j < len(ws) and ((w in given and ws[j] in surnames) or (w in surnames and ws[j] in given)):
                for a in _left(ws, i):
                    for b in _right(ws, j + 1):
                        if a[-1] not in "$#" or b[0] not in "$#":
                            yield (a, b), " ".join(ws[i : j + 1])


class Cues:
    """Contexts that names stand in, learned from texts and a gazetteer: what stands around a given name and a surname of the gazetteer, where
    it does so for several names and what stands there mostly holds a word of the gazetteer. `learn_cues` learns the same from a table."""

    def __init__(self, texts: list[str], given: set[str], surnames: set[str], names: int = 3, share: float = 0.6) -> None:
        known = given | surnames
        letters = {c for w in known for c in w}
        told = [*map(unit_words, texts)]
        seen: dict[Context, set[str]] = {}
        for ws in told:
            for c, name in met(ws, given, surnames):
                seen.setdefault(c, set()).add(name)
        self._take(c for c, of in seen.items() if len(of) >= names)
        count: dict[Context, list[int]] = {}
        for ws in told:
            self.tally(ws, known, letters, count)
        self._take(c for c, n in count.items() if n[0] >= share * n[1])

    @classmethod
    def of(cls, contexts: Iterable[Context]) -> Cues:
        self = cls.__new__(cls)
        self._take(contexts)
        return self

    def _take(self, contexts: Iterable[Context]) -> None:
        self.at: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
        # A text in such a context has the words on either side of it; a sign says no more than the other side.
        self.ends: dict[str, set[str]] = {}
        for a, b in contexts:
            self.at.setdefault(a, set()).add(b)
            x = [w.strip(".") for w in (a[-1], b[0]) if w not in "$#"]
            self.ends.setdefault(x[0], set()).add(x[-1])
        self.firsts = frozenset(self.ends)
        self.before = frozenset(a[-1] for a in self.at)

    def may_be_in(self, words: set[str]) -> bool:
        """Whether a text of these words can have such a context."""
        return any(not words.isdisjoint(self.ends[w]) for w in words & self.firsts)

    def tally(self, ws: list[str], known: set[str], letters: set[str], count: dict[Context, list[int]]) -> None:
        """Add, for each context, the stretches in it that hold a word of the gazetteer and all of them."""
        for i, j, a, b in self.found(ws):
            if letters.isdisjoint("".join(ws[i:j])):  # a stretch in another script says nothing of a context
                continue
            n = count.setdefault((a, b), [0, 0])
            n[0] += not known.isdisjoint(ws[i:j])
            n[1] += 1

    def found(self, ws: list[str]):
        """(i, j, before, after) of the stretches of two to four words in such a context, the shortest first."""
        last = "$"
        for i, w in enumerate(ws):
            before, last = last, w
            if before not in self.before or w in "$#":
                continue
            for a in _left(ws, i):
                if bs := self.at.get(a):
                    for j in range(i + 2, min(len(ws), i + 4) + 1):
                        if ws[j - 1] in "$#":
                            break
                        for b in _right(ws, j):
                            if b in bs:
                                yield i, j, a, b

    def names(self, t: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, whether two words on either side say so)."""
        if not any(True for _ in self.found(unit_words(t))):
            return
        of = units(t)
        last = -1
        every = sorted(self.found([w for w, *_ in of]), key=lambda x: (x[0], x[1], -len(x[2]) - len(x[3])))
        for i, j, a, b in every:
            if i >= last:  # the shortest of those that begin here, by the longest context
                last = j
                yield of[i][1], of[j - 1][2], len(a) > 1 and len(b) > 1


NO_CUES = Cues([], set(), set())


class Spans:
    """A text as rewritten, with the source span of each of its characters; `at` is None while nothing is rewritten."""

    def __init__(self, text: str) -> None:
        self.source = self.text = text
        self.at: list[tuple[int, int]] | None = None
        t = transducer()
        if text.isascii():
            return
        odd = t.odd.of(text).search(text) or not unicodedata.is_normalized("NFKC", text)
        if odd or OTHER_DIGIT.search(text):
            out, at = [], []
            for m in t.cluster.of(text).finditer(text):
                c = m[0]
                plain = t[c] if odd else c
                if len(plain) == 1 and plain > "9" and plain.isdecimal():
                    plain = str(unicodedata.decimal(plain))
                out.append(plain)
                at += [m.span()] * len(plain)
            self.text, self.at = "".join(out), at

    def rewrite(self, pattern: regex.Pattern, to) -> None:
        """Replace each match; what replaces it stands for all that the match stood for."""
        found = [*pattern.finditer(self.text)]
        if not found:
            return
        old = self.at or [(k, k + 1) for k in range(len(self.text))]
        out, at, last = [], [], 0
        for m in found:
            new = to(m)
            out += [self.text[last : m.start()], new]
            at += old[last : m.start()] + [(old[m.start()][0], old[m.end() - 1][1])] * len(new)
            last = m.end()
        out.append(self.text[last:])
        self.text, self.at = "".join(out), at + old[last:]

    def back(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.at is None else (self.at[a][0], self.at[b - 1][1])


def _digits(m) -> str:
    s = "".join(DIGIT_WORDS[w.lower()] for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", m[0]))
    return s + (" " if m[0][-1] in " ,-" else "")


def _address(m) -> str:
    return m[1] + "@" + regex.sub(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s", ".", m[2] or m[3], flags=_i)


def _names(t: str, given: set[str], surnames: set[str], taken: list[tuple[int, int]], any_found: bool, cues: Cues = NO_CUES, present: set[str] = frozenset()) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    shops = _shops()
    free = lambda a, b: all(b <= x or y <= a for x, y in taken)
    low = t.lower()
    cased = low != t and t.upper() != t
    met = not present.isdisjoint(given) or not present.isdisjoint(surnames)
    for p, hint, wide in NAMED:
        if present.isdisjoint(hint) if wide else hint not in low:
            continue
        after = p.pattern.startswith("(?:^")
        for m in p.finditer(t):
            a, b = m.span("name")
            words = t[a:b].split()
            while wide and len(words) > 1 and words[0].lower() in LEADING:
                a = t.index(words[1], a + len(words[0]))
                words = words[1:]
            if (after or wide) and not NOT_NAMES.isdisjoint(w.lower() for w in (words if wide else words[:1])):
                continue
            if free(a, b) and words[-1].lower().strip(".") not in shops and not (len(words) == 1 and len(words[0].strip(".")) == 1):
                known = [w for w in words if w.lower() in given or w.lower() in surnames]
                if wide:
                    # The first of two words beginning a sentence is capitalised anyway.
                    right = known or (cased and all(w[0].isupper() for w in words) and len(words) > 1)
                else:
                    right = not after or known or (words[0][0].isupper() and len(words) > 1)
                if right:
                    out.append((a, b))
    if not present.isdisjoint(TITLES):
        for m in TITLED.finditer(t):
            words = m["name"].lower().split()
            if cased and words[-1] not in shops and words[0].strip(".") not in NOT_NAMES and free(*m.span("name")):
                out.append(m.span("name"))
    if cues.may_be_in(present):
        for a, b, sure in cues.names(t):
            words = t[a:b].split()
            name = sure or any(w.lower().strip(".") in given or w.lower().strip(".") in surnames for w in words) or not cased or all(w[0].upper() == w[0] for w in words)
            if name and free(a, b) and shops.isdisjoint(w.lower() for w in words) and words[0].lower() not in NOT_NAMES:
                out.append((a, b))
    found = [(m.span(1), m[1].lower()) for m in TOKEN.finditer(t)] if met else []
    for k, ((a, b), w) in enumerate(found):
        if w not in given and w not in surnames:
            continue
        nxt = [x for x in found[k + 1 : k + 3] if t[b : x[0][0]].count(" ") <= 2]
        if not nxt:
            continue
        other = nxt[0]
        if len(other[1]) == 1 and len(nxt) > 1:
            other = nxt[1]
        gap = t[b : other[0][0]]
        pair = (w in given and other[1] in surnames) or (w in surnames and other[1] in given)
        if pair and regex.fullmatch(r" (?:\p{L}\.? )?", gap) and free(a, other[0][1]):
            after = found[k + 2 + (other is not nxt[0])][1] if len(found) > k + 2 + (other is not nxt[0]) else ""
            if after not in shops or not t[other[0][1] :].lstrip().lower().startswith(after):
                out.append((a, other[0][1]))
    if any_found or out:
        for m in ITEM.finditer(t):
            if (x := NAME_ITEM.fullmatch(m[0])) and (m.start() or m.end() < len(t)):
                words = [w.strip(".").lower() for w in x[1].split()]
                known = any(w in given or w in surnames for w in words)
                beside = any(0 <= a - m.end() <= 2 or 0 <= m.start() - b <= 3 for a, b in taken)
                if (known or beside) and not shops & {*words}:
                    out.append((m.start() + x.start(1), m.start() + x.end(1)))
    for m in PAIR.finditer(t) if met else ():
        words = [w.strip(".").lower() for w in m[1].split()]
        if (words[0] in given or words[-1] in given or words[-1] in surnames or words[0] in surnames) and not shops & {*words} and all(w[0].isupper() for w in m[1].split()) and free(*m.span(1)):
            out.append(m.span(1))
    return [s for s in out if free(*s)]


_shop_set: frozenset[str] | None = None


def _shops() -> frozenset[str]:
    global _shop_set
    if _shop_set is None:
        _shop_set = frozenset(SHOPS.split())
    return _shop_set


def find(text: str, given: set[str] = frozenset(), surnames: set[str] = frozenset(), cues: Cues = NO_CUES) -> list[tuple[int, int, str]]:
    """(start, end, type) in the text, in order and apart."""
    s = Spans(text)
    low = s.text.lower()
    words = {*word_pattern().findall(low)}
    if not words.isdisjoint(DIGIT_WORDS) and TWO_DIGIT_WORDS.search(low) and SPELLED.search(s.text):
        s.rewrite(SPELLED, _digits)
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def take(a: int, b: int, kind: str) -> None:
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            found.append((a, b, kind))

    if SIGN.search(low) or " dot " in low or (("at" in words or "@" in low) and AT.search(low)):
        s.rewrite(DISGUISED, _address)
    t = s.text
    if "@" in t:
        for m in EMAIL.finditer(t):
            take(*m.span(), "EMAIL")
    if not words.isdisjoint(STREET_WORDS) if low.isascii() else HAS_STREET.search(low):
        for m in ADDRESS.finditer(t):
            take(*m.span(), "ADDRESS")
    for p, kind, may in ((CARD, "ID_NUMBER", DIGITS), (PHONE, "PHONE", DIGITS), (LETTERED, "ID_NUMBER", CODE)):
        for m in p.finditer(t) if may.search(t) else ():
            n = sum(map(str.isdigit, m[0]))
            if kind == "PHONE" and not 10 <= n <= 15:
                continue
            if kind == "PHONE" and {*map(len, parts := m[0].split())} == {2} and parts == sorted(parts):  # numbers in a row
                continue
            if m[0][0] in "aiAI" and m[0][1] == " " or OTHER_NUMBER.search(t[max(0, m.start() - 16) : m.start()]):
                continue
            take(*m.span(), kind)
    for a, b in sorted(_names(t, given, surnames, [*taken], bool(found), cues, words), key=lambda x: (x[0], -x[1])):
        take(a, b, "NAME")
    return sorted((*s.back(a, b), k) for a, b, k in found)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, k in spans:
        out += [text[last:a], f"[{k}]"]
        last = b
    return "".join([*out, text[last:]])


def _gazetteer(names: DataFrame) -> tuple[set[str], set[str]]:
    given, surnames = set(), set()
    for k, r in enumerate(names.where("name is not null").select("name", "kind").distinct().toLocalIterator()):
        (surnames if r["kind"] == "surname" else given).add(r["name"].strip().lower())
        if k % 10_000 == 0:
            check_broadcast(deep_size(given) + deep_size(surnames))
    return given, surnames


def _met(batches: Iterator[pa.RecordBatch], given: set[str], surnames: set[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set[tuple[str, str, str]] = set()
        for text in {*batch.column(0).to_pylist()}:
            ws = unit_words(without_addresses(text))
            if not given.isdisjoint(ws) and not surnames.isdisjoint(ws):
                seen.update((" ".join(a), " ".join(b), name) for (a, b), name in met(ws, given, surnames))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.string()) for k in range(3)], names=["a", "b", "name"])


def _tallies(batches: Iterator[pa.RecordBatch], contexts: list[Context], known: set[str]) -> Iterator[pa.RecordBatch]:
    """A row for a text: its hash, the places of its contexts in the list, and the two counts of `Cues.tally` for each."""
    cues, ids, letters = Cues.of(contexts), {c: k for k, c in enumerate(contexts)}, {c for w in known for c in w}
    for batch in batches:
        out: list[tuple[bytes, list[dict[str, int]]]] = []
        for text in {*batch.column(0).to_pylist()}:
            count: dict[Context, list[int]] = {}
            cues.tally(unit_words(without_addresses(text)), known, letters, count)
            if count:
                out.append((xxhash.xxh3_128_digest(text), [{"id": ids[c], "hits": n[0], "n": n[1]} for c, n in count.items()]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.list_(pa.struct([("id", pa.int32()), ("hits", pa.int32()), ("n", pa.int32())])))], names=["text", "counts"])


def learn_cues(texts: DataFrame, given: set[str], surnames: set[str], names: int = 3, share: float = 0.6, block: int = 100_000) -> Cues:
    """What `Cues` learns from all the different texts, in two passes over the table: contexts that several names stand in, then how
    often these hold a word of the gazetteer. The second pass takes `block` contexts at a time, so what is broadcast is bounded."""
    if not given or not surnames:
        return NO_CUES
    texts = texts.where("text is not null").select("text")
    seen = texts.mapInArrow(partial(_met, given=given, surnames=surnames), "a string, b string, name string").distinct()
    several = written(seen.groupBy("a", "b").count().where(F.col("count") >= names).select("a", "b"))
    blocks = -(-several.count() // block)
    good: list[Context] = []
    for k in range(blocks):
        part = several.where(F.pmod(F.xxhash64("a", "b"), F.lit(blocks)) == k)
        contexts = sorted((tuple(r["a"].split(" ")), tuple(r["b"].split(" "))) for r in part.collect())
        rows = texts.mapInArrow(partial(_tallies, contexts=contexts, known=given | surnames), "text binary, counts array<struct<id: int, hits: int, n: int>>")
        sums = rows.dropDuplicates(["text"]).select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.hits").alias("hits"), F.sum("c.n").alias("n"))
        good += [contexts[r["id"]] for r in sums.where(F.col("hits") >= F.lit(share) * F.col("n")).collect()]
    release(several)
    return Cues.of(sorted(good))


def without_addresses(text: str) -> str:
    """The rewritten text, its mail addresses cut out, as names in them tell nothing of contexts."""
    s = Spans(text)
    low = s.text.lower()
    if "@" in low or ("at" in low and ("dot" in low or AT.search(low))):  # all that DISGUISED needs
        s.rewrite(DISGUISED, _address)
    return EMAIL.sub("|", s.text) if "@" in s.text else s.text


def _run(batches: Iterator[pa.RecordBatch], given: set[str], surnames: set[str], cues: Cues) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        spans = [find(t, given, surnames, cues) if t else [] for t in texts]
        clean = [t if not x else redact(t, x) for t, x in zip(texts, spans)]
        kinds = [sorted({k for *_, k in x}) for x in spans]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(map(len, spans), pa.int32())], names=["src", "row_id", "clean_text", "types", "n_found"])


def redacted(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(src, key, text) to (src, row_id, clean_text, types, n_found), a row for each."""
    given, surnames = _gazetteer(names)
    cues = learn_cues(texts, given, surnames)
    check_broadcast(deep_size(given) + deep_size(surnames) + deep_size(cues.at))
    run = partial(_run, given=given, surnames=surnames, cues=cues)
    return texts.select("src", "key", "text").mapInArrow(run, "src string, row_id bigint, clean_text string, types array<string>, n_found int")


def p1_found(spark, sf_dir: str) -> DataFrame:
    texts = both_texts(spark, sf_dir, "english_text").where(F.col("key").isNotNull() & not_blank("text"))
    found = redacted(texts, table(spark, sf_dir, "name_gazetteer"))
    return found.select("src", "row_id", F.explode("types").alias("pii_type")).distinct()


def p1_redacted(spark, sf_dir: str) -> DataFrame:
    """Every text with its placeholders, once for each id."""
    found = redacted(both_texts(spark, sf_dir, "english_text"), table(spark, sf_dir, "name_gazetteer"))
    return found.dropDuplicates(["src", "row_id"])


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
