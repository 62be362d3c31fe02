"""Personal information in free text: generators propose spans, boosted trees score them, calibrated thresholds select."""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.boost import Boosted
from quarry.session import spread

MODEL = str(Path(__file__).with_name("pii_model.json"))
#: A vocabulary of byte pairs, one "base64 rank" a line; its whole small words are ordinary words.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("email", "phone", "id_number", "address", "name")

# --- generators: wide nets, in which each kind's cases lie ---------------------------------------------------------
_AT = r"(?:[@＠]|&#64;|&commat;|[ \t]?[\[({<][ \t]?(?:at|AT|At|@|arroba|ät)[ \t]?[\])}>][ \t]?|[ \t](?:at|AT|arroba)[ \t]|_at_)"
_DOT = r"(?:\.|[ \t]?[\[({<][ \t]?(?:dot|punkt|punto|\.)[ \t]?[\])}>][ \t]?|[ \t](?:dot|DOT|punto|punkt)[ \t])"
_AT_SIGN = re.compile(_AT)
_LOCAL = re.compile(rf"(?i)[\w+%'-]+(?:(?:\.|{_DOT})[\w+%'-]+)*$")
_HOST = re.compile(rf"(?i)[\w-]+(?:{_DOT}[\w-]+)+")
_GAP = r"[ \t    .\-/()‐‑–—]"
#: Digits in a row with gaps; then the whole number with its prefix and its end.
_DIGITS = re.compile(rf"\d(?:{_GAP}{{0,3}}\d){{4,24}}")
_PREFIX = re.compile(r"(?:[+(]{1,2}|(?<![\w])[A-Z]{1,2}[ -]?|(?<![\w])[+(]{0,2}[A-Z]{1,2}[ -]?)$")
_NUMBER = re.compile(rf"(?<![\w.@#/-])(?:(?<!\w[:/-])|(?<==))[+(]{{0,2}}(?:[A-Z]{{1,2}}[ -]?)?\d(?:{_GAP}{{0,3}}\d){{5,24}}(?:{_GAP}?[A-Z](?![\w]))?(?:[  ]?(?:ext|x|Durchwahl|poste|int)\.?[  ]?\d{{1,6}})?(?![\w@])")
_STAMP = re.compile(r"\d{4}[-/.]\d\d[-/.]\d\d(?:[ T]\d\d:|\s|$|[^\d-])")
_STREET = r"(?:[Ss]treet|STREET|St\.|ST\.|Ave(?:nue)?\b\.?|AVE(?:NUE)?\b\.?|Lane|LANE|Ln\.|LN\.|Rd\.|RD\.|Road|ROAD|Court|COURT|Ct\.|CT\.|Blvd\b\.?|BLVD\b\.?|Boulevard|Drive|DRIVE|Dr\.|Way|WAY|Square|SQUARE|Sq\.|Place|PLACE|Pl\.|Terrace|TERRACE|Close|Crescent|Row|ROW|Alley|ALLEY|Highway|HIGHWAY)"
_RUE = r"(?:[Rr]ue|RUE|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]ll[ée]e|[Qq]uai|[Ii]mpasse)"
_CALLE = r"(?:[Cc]alle|CALLE|C/|[Aa]venida|AVENIDA|Avda?\.|[Pp]laza|PLAZA|[Pp]aseo|[Cc]arrera)"
_WEG = r"(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|damm|ufer|STRASSE|WEG|PLATZ|GASSE)"
_BOX = r"(?:[Pp]\.?[ ]?[Oo]\.?[ ]?(?:[Bb]ox|BOX)|[Pp]ost(?:al)? (?:[Oo]ffice )?[Bb]ox|[Pp]ostfach|POSTFACH|[Aa]partado(?: de [Cc]orreos)?|[Cc]asilla|[Bb]o[iî]te [Pp]ostale|B\.?P\.?)"
#: A word that addresses have; around it, the address itself. The window holds what may come before the word.
_ADDRESS_WORD = re.compile(rf"{_STREET}(?!\w)|{_RUE} d|{_RUE} [A-Z]|{_CALLE} |{_WEG} \d|{_BOX} \d")
_ADDRESS_PARTS = (
    "Street STREET St. ST. Ave AVE Lane LANE Ln. LN. Rd. RD. Road ROAD Court COURT Ct. CT. Blvd BLVD oulevard Drive DRIVE Dr. Way WAY Square SQUARE Sq. Place PLACE Pl. Terrace TERRACE Close Crescent Row ROW Alley ALLEY Highway HIGHWAY "
    "Rue RUE allée Allée quai Quai mpasse C/ venida VENIDA Avda laza PLAZA Paseo paseo arrera straße strasse STRASSE asilla ostale B.P."
).split() + ["rue d", "rue D", "venue d", "lace d", "hemin d", "alle ", "ALLE ", "weg ", "platz ", "gasse ", "allee ", "damm ", "ufer ", "str. ", "WEG ", "PLATZ ", "Box ", "box ", "BOX ", "ostfach ", "OSTFACH ", "partado ", "BP "]
_ADDRESS = re.compile(
    r"(?<![\w.-])(?:"
    rf"{_BOX} \d+"
    rf"|\d{{1,5}}[a-zA-Z]?,? (?:[^\W\d_][\w'’-]*\.? ){{1,3}}{_STREET}(?![\w])"
    rf"|(?:[^\W\d_][\w'’-]+ ){{1,2}}{_STREET},? \d{{1,5}}[a-z]?(?![\w])"
    rf"|\d{{1,5}}[a-z]?(?: ?(?:bis|ter))?,? {_RUE} (?:(?:[Dd]e la|[Dd]e l['’]|[Dd]u|[Dd]es|[Dd]e|[Dd]['’]|DU|DE LA|DE) ?)?[^\W\d_][\w'’-]+"
    rf"|{_CALLE} (?:(?:de la|de los|del|de|la) )?[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+)?,? (?:n[.ºo°]* ?)?\d{{1,5}}[a-z]?"
    rf"|[^\W\d_][\w-]*{_WEG} \d{{1,5}}[a-z]?(?![\w])"
    r")"
)
_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮŁŃŇŌŐŒŘŚŞŠŤŪŮŰŲŹŻŽΑ-ΩА-ЯЁІЇЄҐ", "a-zß-öø-ÿāăąćčďđēėęěğģīįłńňōőœřśşšťūůűųźżžά-ώа-яёіїєґ"
_TITLE = rf"(?:(?:[Dd]|[OL])['’])?[{_UP}][{_LOW}]+(?:[-'’][{_UP}]?[{_LOW}]+)*"
_UPPER = rf"(?:[DOL]['’])?[{_UP}]{{2,}}(?:[-'’][{_UP}]+)*"
_LOWER = rf"(?:[dol]['’])?[{_LOW}]{{2,}}(?:[-'’][{_LOW}]+)*"
_PARTICLES = frozenset(("van", "von", "der", "den", "de", "da", "di", "du", "del", "la", "le", "bin", "al", "el", "ter", "dos", "zu"))
_PARTICLE = rf"(?:(?:{'|'.join(sorted(_PARTICLES))})[ ]){{0,2}}"
_SP = r"[  ]{1,2}"


def _name(word: str, initial: str, tail: str) -> str:
    return rf"(?:(?:{word}|{initial}){_SP}(?:{initial}{_SP})?{_PARTICLE}{word}|{word},{_SP}(?:{word}(?:{_SP}{initial})?|{initial}(?![{tail}])))"


_INITIAL = rf"[{_UP}]\."
_NAME = re.compile(rf"(?<![\w@'’.+&/\\-])(?:{_name(_TITLE, _INITIAL, _LOW)}|{_name(_UPPER, _INITIAL, _UP)})(?![\w@'’])")
_PAIR = re.compile(rf"[{_UP}](?:[\w'’-]*,?|\.)[  ]{{1,2}}(?:[a-z]{{2,3}}[ ]){{0,2}}(?:[dDOL]['’])?[{_UP}]")
_NAME_LOW = re.compile(rf"(?:[=\"|,:(>：；，。.;!?\n][ \n]?|(?<=[ \n])(?:to|by|of|an|a|and|for|was|von|ask|Ask|par|with|from|revisó)[ \n]|(?:属于|联系|请联系|担当は)[ \n]?)(?={_name(_LOWER, rf'[{_LOW}]\.', _LOW)}(?![\w@'’(]))")
_NAME_LOW_AT = re.compile(rf"{_name(_LOWER, rf'[{_LOW}]\.', _LOW)}(?![\w@'’(])")

# Frequent family names in Han characters.
_HAN_FAMILY = "王 李 张 張 刘 劉 陈 陳 杨 楊 赵 趙 黄 黃 周 吴 吳 徐 孙 孫 胡 朱 高 林 何 郭 马 馬 罗 羅 梁 宋 郑 鄭 谢 謝 韩 韓 唐 冯 馮 于 董 萧 蕭 程 曹 袁 邓 鄧 许 許 傅 沈 曾 彭 吕 呂 苏 蘇 卢 盧 蒋 蔣 蔡 贾 丁 魏 薛 叶 葉 阎 余 潘 杜 戴 夏 钟 鍾 汪 田 任 姜 范 方 石 姚 谭 廖 邹 熊 金 陆 郝 孔 白 崔 康 毛 邱 秦 江 史 顾 侯 邵 孟 龙 万 段 雷 钱 汤 尹 黎 易 常 武 乔 贺 赖 龚 文 欧阳 司马 上官 诸葛".split()
_KANJI_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 福田 太田 西村 藤井 金子 三浦 岡本 藤原 中野 原田 松田 竹内 中川 小野 田村".split()
_HAN = "\u3400-\u9fff"
_HAN_NAME = re.compile(rf"(?:{'|'.join(sorted(map(re.escape, _KANJI_FAMILY), key=len, reverse=True))})[ 　]?[{_HAN}\u3040-\u30ff]{{1,3}}?(?=(?:さん|様|氏|先生|くん)|[^{_HAN}\u3040-\u30ff]|[のはがをにへともや]|$)|(?:{'|'.join(sorted(_HAN_FAMILY, key=len, reverse=True))})[{_HAN}]{{1,2}}?(?=(?:先生|女士|小姐|同志|老师|经理)|[^{_HAN}]|[的是在和与说把被将负提已为]|$)")
_HAN_CUE = re.compile(r"(?:姓名|名字|联系人|联系|负责人|作者|用户|申请人|收件人|寄给|致|由|找|给|叫|担当者?|氏名|名前|お名前|宛|連絡先|署名|報告者)(?:[是为は]|[:：]|\s|は、)*$")
_HAN_TITLE = re.compile(r"\s*(?:さん|様|氏|先生|女士|小姐|同志|老师|经理)")
_HAN_ADDRESS = re.compile(rf"(?:[{_HAN}]{{2,8}}?(?:省|自治区))?(?:[{_HAN}]{{2,8}}?市)?(?:[{_HAN}]{{1,6}}?[区县])?[{_HAN}]{{1,8}}(?:路|街|大道|巷|弄|胡同)\s?\d{{1,5}}\s?[号弄]|(?:東京都|北海道|京都府|大阪府|[{_HAN}]{{2,3}}県)[{_HAN}\u3040-\u30ff]{{2,16}}?\s?\d{{1,4}}(?:[-−丁目番地号]{{1,2}}\d{{1,4}}){{0,3}}")
_FAR = re.compile(rf"[{_HAN}А-я]")
_HAN_LEAD = re.compile(r"(?:邮?寄[到往给]|住在|住|位于|送[到往至]|搬到|地址[是为]?|在|到)")
_RUSSIAN_ADDRESS = re.compile(r"(?<!\w)(?:ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|наб\.|набережная|бульвар|б-р|площадь|пл\.)\s?[А-ЯЁ][а-яё-]+(?: [А-ЯЁ][а-яё-]+)?,? (?:д\. ?|дом )?\d{1,4}[а-я]?(?!\w)")

# --- cues ---------------------------------------------------------------------------------------------------------
_CUES = {
    "phone": r"телефон|тел|звоните|моб|call|ring|phone|tel(?:[eé]f\w*)?|mobile|cell|fax|sms|whatsapp|dial|desk|llam[ea]\w*|joindre|anruf\w*|rufen|nummer|num[eé]ro|電話|电话|手机|携帯|contact",
    "id": r"паспорт|снилс|инн|social|security|personal|passport|pass(?:eport|aporte|nummer)?|personal (?:number|no|id)|national|identit[yéà]\w*|id(?:entity)?(?: card| no| number)?|nid|ssn|social security|tax|dni|nif|nie|curp|ausweis\w*|personalausweis|steuer\w*|carte|licen[cs]e|身份证号?|护照|マイナンバー|旅券|insurance",
    "address": r"адрес|проживает|улица|lives? at|resid\w+|street address|mail to|parcel|address|adresse|direcci[oó]n|anschrift|ship|deliver\w*|live[sd]?|home|send|enviar|livraison|lieferadresse|wohn\w*|ship_to|box|street|住所|地址",
    "name": r"a|à|par|of|pour|para|por|für|bei|zu|de|имя|фио|автор|контакт|от|mrs|prof|подготовил|написал|сообщил|спросите|colleague|manager|customer|patient|client|sincerely|regards|best|hi|hello|dear|nombre|nom|firma|gracias|merci|danke|name|by|from|user|contact|author|owner|maintainer|reviewed|reported|thanks|with|ask|mr|mrs|ms|dr|frau|herr|sr|sra|m|mme|signed|co-written|cc|to|von|an|属于|联系|担当|氏名|姓名|revis[oó]|signal[eé]|and|was|for|bitte",
    "other": r"build|version|release|trace|error|code|issue|order|ticket|commit|host|port|ip|pr|bug|run|job|invoice|serial|part|sku|batch|seed|offset|line|row|bytes|ms|took|hash|id|model|codename|replaces|project",
}
_CUE_ORDER = tuple(re.compile(rf"(?i)(?:{v})\Z") for v in _CUES.values())
_CUE_HAN = tuple(re.compile(v) for v in _CUES.values())
_CONTEXT_WORD = re.compile(r"[^\W_]+")
_MASKS: dict[str, int] = {}
_NAME_CUE = 1 << list(_CUES).index("name")


def _mask(word: str) -> int:
    """The kinds of cue that a word is, as bits; of words without blanks between them (Han, Kana) a part is enough."""
    known = _MASKS.get(word)
    if known is None:
        if len(_MASKS) > 100_000:
            _MASKS.clear()
        tests = _CUE_ORDER if word.isascii() or word < "\u3000" else _CUE_HAN
        known = _MASKS[word] = sum(1 << i for i, r in enumerate(tests) if (r.match(word) if tests is _CUE_ORDER else r.search(word)))
    return known


_BITS = [[float(m >> i & 1) for i in range(len(_CUES))] for m in range(1 << len(_CUES))]
_RIGHT = re.compile(r"(?i)^\W{0,3}(?:on|mentioned|wants|is|who|set|for|and|liegt|hat|before|says?|said|wrote|reported|was|will|has|asked|failed|shows|in|from|aparece|est|en|at)\b")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_SHAPE = {c: s for s, cs in (("d", "0123456789"), ("s", " \t   "), ("-", "-‐‑–—"), (".", "."), ("/", "/"), ("(", "()"), ("+", "+"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in cs}


#: Words between a cue and its number.
_NUMBERED = frozenset("no nr number nummer numero número is ist es est me at on to".split())


# Articles, pronouns and the like of four languages.
_FUNCTION = frozenset("the this that these those every each all any some both no not a an and or but if when while after before because with without from into onto over under der die das den dem des ein eine einen einem einer kein keine dieser diese dieses wenn weil nach vor mit ohne und oder aber el la los las un una unos unas este esta estos si cuando antes después con sin y o pero le les une ces cette quand avant après avec sans et ou mais ce on il elle ils nous vous".split())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> frozenset[str]:
    """Words that the vocabulary has whole and in small letters."""
    out = set()
    with open(path, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" " and len(token) > 3 and token[1:].isalpha() and token[1:].islower():
                out.add(token[1:].decode("utf-8", "ignore"))
    return frozenset(out)


@lru_cache(maxsize=1)
def _address_parts():
    import ahocorasick

    parts = ahocorasick.Automaton()
    for part in _ADDRESS_PARTS:
        parts.add_word(part, len(part))
    parts.make_automaton()
    return parts


def address_words(text: str) -> Iterator[re.Match]:
    """Words that addresses have, in order; the patterns are only tried around the fixed parts that an automaton finds in one pass."""
    at = 0
    for end, size in _address_parts().iter(text):
        if end >= at and (m := _ADDRESS_WORD.search(text, max(at, end - size - 9), end + 12)):
            yield m
            at = m.end()


class Candidate:
    __slots__ = ("kind", "start", "end", "x")

    def __init__(self, kind: str, start: int, end: int, x: list[float]):
        self.kind, self.start, self.end, self.x = kind, start, end, x


class Generator:
    """Proposes spans, also overlapping ones, with their features. `common`: words that texts mostly write small, a feature and no filter; `endings`: log-odds of word endings in names."""

    def __init__(self, common: set[str], endings: dict[str, float], tokenizer: str = TOKENIZER):
        self.common, self.endings = common | _FUNCTION | vocabulary(tokenizer), endings

    def context(self, text: str, start: int, end: int) -> list[float]:
        line = text.rfind("\n", 0, start) + 1
        left = text[max(line, start - 48) : start]
        stop = text.find("\n", end)
        right = text[end : min(end + 32, stop if stop >= 0 else len(text))]
        words = _CONTEXT_WORD.findall(left)
        near = last = 0
        for w in words:
            near |= _mask(w)
        if words and left.rfind(words[-1]) + len(words[-1]) >= len(left) - 4:
            last = _mask(words[-1])
            if len(words) > 1 and words[-1].lower() in _NUMBERED:
                last |= _mask(words[-2])
        before, after = left[-1:], right[:1]
        out = _BITS[last] + _BITS[near]
        out += [
            float(start == line), float(start - line < 3), float(not right.strip()), float(before in "\"'`"), float(before == "="), float(before == "<" or before == "("), float(before in ",|" or left[-2:] in ("| ", ", ")),
            float(left[-2:] in (": ", ":") or before in ":："), float(after in "\"'`"), float(after in "<(" or right[:2] in (" <", " (")), float(after in ",;"), float(after == "." ), float(right[:2] == " |"),
            float("@" in right or "[at]" in right or "(at)" in right), float("@" in left), float(bool(_RIGHT.match(right))), float(sum(c.isdigit() for c in left[-12:])), float(bool(re.match(r"\W{0,3}\d", right))), float(sum(c.isdigit() for c in right)), float(right[:3] in (" | ", '", ', "), ") or right[:1] == ";"), float(not words or not words[-1][:1].islower()),
        ]
        prev = text[text.rfind("\n", 0, max(0, line - 1)) + 1 : max(0, line - 1)] if line else ""
        after_line = text[stop + 1 : stop + 80].split("\n", 1)[0] if stop >= 0 else ""
        near = prev[-80:] + "\n" + after_line
        out += [float("@" in near or "[at]" in near), float(sum(c.isdigit() for c in near) > 6), float(len(prev) < 40), float(len(after_line) < 40)]
        return out

    def number(self, text: str, start: int, end: int) -> list[float]:
        span = text[start:end]
        digits = re.sub(r"\D", "", span)
        shape = "".join(_SHAPE.get(c, "o") for c in span)
        groups = [len(g) for g in re.findall(r"\d+", span)]
        counts = [float(shape.count(c)) for c in "s-./(+A"]
        return [float(len(span)), float(len(digits)), float(len(groups)), float(groups[0]), float(groups[-1]), float(max(groups)), float(min(groups)), *counts, float(span[0] == "+"), float(digits.startswith("00")), float(digits.startswith("0")),
                float("ext" in span), float(span[-1].isalpha()), float(span[0].isalpha()), float("555" in digits[:7]), float(groups[:3] == [3, 2, 4]), float(groups == [4, 2, 2] or groups[:3] == [4, 2, 2]), float(groups[0] == 4 and span[4:5] in ".-/")]

    def words(self, span: str) -> list[float]:
        ws = _LETTERS.findall(span)
        low = [w.lower() for w in ws]
        ends = [self.endings.get(w[-3:], 0.0) for w in low] or [0.0]
        firsts = [self.endings.get("^" + w[:3], 0.0) for w in low] or [0.0]
        known = [w in self.common for w in low] or [False]
        return [float(len(span)), float(len(ws)), float(sum(known)), float(known[0]), float(known[-1]), ends[0], ends[-1], max(ends), firsts[0], firsts[-1], float(bool(re.search(r"(?<!\w)[^\W\d_]\.", span))), float("," in span),
                float(span.isupper()), float(span.islower()), float("-" in span), float(min(map(len, low), default=0)), float(max(map(len, low), default=0)), float("'" in span or "’" in span)]

    def propose(self, text: str) -> list[Candidate]:
        out: list[Candidate] = []
        if "@" in text or "＠" in text or "at]" in text or "at)" in text or "AT]" in text or "AT)" in text or "at}" in text or "&#64;" in text or "_at_" in text or (" at " in text and " dot " in text) or "arroba" in text:
            last = 0
            for m in _AT_SIGN.finditer(text):
                local, host = _LOCAL.search(text, max(last, m.start() - 90), m.start()), _HOST.match(text, m.end())
                if not local or not host or (local.start() and text[local.start() - 1] in ".%"):
                    continue
                start, end = local.start(), host.end()
                last = end
                s, h = text[start:end], host[0]
                x = [float(len(s)), float("@" in s), float("[" in s or "(" in s), float(" at " in s.lower()), float(bool(re.search(r"\d+[.\d]*$", s))), float(s[:1].isdigit()), float(h.count(".")), float("dot" in s.lower()), float(s.startswith("git@")), float(text[end : end + 1] in (":", "/")), float("://" in text[max(0, start - 12) : start]), float(len(h))]
                out.append(Candidate("email", start, end, x + self.context(text, start, end)))
        at = 0
        while d := _DIGITS.search(text, at):
            at = d.end()
            stamp = _STAMP.match(text, d.start())
            if stamp:  # what follows a date may be a number of its own
                at = d.start() + 10
                continue
            prefix = _PREFIX.search(text, max(0, d.start() - 5), d.start())
            m = (_NUMBER.match(text, prefix.start()) if prefix else None) or _NUMBER.match(text, d.start())
            if not m:
                continue
            at = max(at, m.end())
            x = self.number(text, m.start(), m.end()) + self.context(text, m.start(), m.end())
            out.append(Candidate("phone", m.start(), m.end(), x))
            out.append(Candidate("id_number", m.start(), m.end(), x))
        last = 0
        for word in address_words(text):
            if word.start() < last:
                continue
            from_ = max(last, text.rfind("\n", 0, word.start()) + 1, word.start() - 60)
            while (m := _ADDRESS.search(text, from_, word.end() + 60)) and m.end() < word.end():
                from_ = m.start() + 1
            if not m or m.start() > word.start():
                continue
            start, last = m.start(), m.end()
            span = text[start:last]
            if not span[0].isdigit() and not re.match(rf"{_BOX} \d", span):  # words before the street that belong to the sentence
                parts = list(re.finditer(r"[^\W\d_][\w'’.-]*", span))
                while len(parts) > 2 and parts[0][0].lower() in self.common:
                    parts.pop(0)
                    start = m.start() + parts[0].start()
            out.append(self.address(text, start, last))
        if _FAR.search(text):
            for pattern in (_HAN_ADDRESS, _RUSSIAN_ADDRESS):
                for m in pattern.finditer(text):
                    lead = _HAN_LEAD.match(m[0])
                    out.append(self.address(text, m.start() + (lead.end() if lead else 0), m.end()))
            for m in _HAN_NAME.finditer(text):
                cue, title = bool(_HAN_CUE.search(text, max(0, m.start() - 12), m.start())), bool(_HAN_TITLE.match(text, m.end()))
                if cue or title:
                    out.append(Candidate("name", m.start(), m.end(), self.words(m[0]) + [1.0 + cue + 2 * title] + self.context(text, m.start(), m.end())))
        at = 0
        while anchor := _PAIR.search(text, at):
            start = anchor.start()
            if text[max(0, start - 2) : start] in ("d'", "d’"):
                start -= 2
            m = _NAME.match(text, start)
            step = re.match(r"\S+", text[start : anchor.end()])
            at = start + len(step[0]) if step else anchor.start() + 1
            if m and not self.ordinary(text, start, m[0]):
                out.append(Candidate("name", start, m.end(), self.words(m[0]) + [0.0] + self.context(text, start, m.end())))
        for cue in _NAME_LOW.finditer(text):
            m = _NAME_LOW_AT.match(text, cue.end())
            if m and not all(w in self.common for w in _LETTERS.findall(m[0])):
                out.append(Candidate("name", m.start(), m.end(), self.words(m[0]) + [0.0] + self.context(text, m.start(), m.end())))
        return out

    def ordinary(self, text: str, start: int, span: str) -> bool:
        """Whether a span has only ordinary words and nothing before it names a person."""
        for w in _LETTERS.findall(span):
            if w.lower() not in self.common:
                return False
        words = _CONTEXT_WORD.findall(text[max(0, start - 16) : start])
        return not words or not _mask(words[-1]) & _NAME_CUE

    def address(self, text: str, start: int, end: int) -> Candidate:
        span = text[start:end]
        x = [float(bool(re.search(r"\d", span))), float(span[:1].isdigit()), float(bool(re.match(r"(?i)p\.?", span))), float(span[:1].isupper()), float(bool(_STREET_SMALL.search(span))), float(not span.isascii())]
        return Candidate("address", start, end, x + self.words(span) + self.context(text, start, end))


#: Street words written small in a text of capitals are ordinary words: "12 rows in a row".
_STREET_SMALL = re.compile(r"\b(?:street|ave|avenue|lane|road|rd|court|drive|way|square|place|terrace|close|crescent|row|alley)\b")


class Redactor:
    """Selects among proposed spans: the trees of each kind give a probability, calibrated; the kind's threshold decides, overlaps go to the surer span."""

    def __init__(self, path: str = MODEL, tokenizer: str = TOKENIZER):
        state = json.loads(Path(path).read_text())
        self.generator = Generator(set(state["common"]), state["endings"], tokenizer)
        self.trees = {k: Boosted.load(v) for k, v in state["trees"].items()}
        self.scale, self.least = state["scale"], state["thresholds"]

    def score(self, kind: str, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return calibrated(self.trees[kind].score(x), *self.scale[kind])

    def select(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per text its (start, end, kind), in order, without overlaps."""
        proposed = [self.generator.propose(t) if t else [] for t in texts]
        chosen: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
        for kind in KINDS:
            own = [(i, c) for i, cs in enumerate(proposed) for c in cs if c.kind == kind]
            if own:
                for (i, c), p in zip(own, self.score(kind, np.array([c.x for _, c in own]))):
                    if p >= self.least[kind]:
                        chosen[i].append((p + (kind == "email") + 0.5 * (kind == "address"), c.start, c.end, kind))
        out = []
        for spans in chosen:
            kept: list[tuple[int, int, str]] = []
            for _, start, end, kind in sorted(spans, key=lambda s: (-s[0], s[1] - s[2], s[1])):
                i = bisect_left(kept, (start, end, ""))
                if (i == len(kept) or kept[i][0] >= end) and (i == 0 or kept[i - 1][1] <= start):
                    kept.insert(i, (start, end, kind))
            out.append(kept)
        return out


def calibrated(p: np.ndarray, slope: float, shift: float) -> np.ndarray:
    """Probabilities after Platt scaling of their log-odds."""
    odds = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
    return 1 / (1 + np.exp(-np.clip(slope * odds + shift, -40, 40)))


@lru_cache(maxsize=2)
def _redactor(path: str, tokenizer: str) -> Redactor:
    return Redactor(path, tokenizer)


def _spans(path: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _redactor(path, tokenizer)
        for batch in batches:
            keys, texts = (c.to_pylist() for c in batch.columns)
            rows = [(k, *s) for k, spans in zip(keys, model.select(texts)) for s in spans]
            k, a, b, kind = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(kind, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "kind", "start_at", "end_at"])

    return run


def placeholders(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind in brackets, such as [EMAIL]."""
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _replaced(path: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _redactor(path, tokenizer)
        for batch in batches:
            keys, texts = (c.to_pylist() for c in batch.columns)
            spans = model.select(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([placeholders(t, s) for t, s in zip(texts, spans)], pa.string()), pa.array([len(s) for s in spans], pa.int32())], ["doc_id", "text", "replaced"]
            )

    return run


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).dropna())


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, kind, start_at, end_at) of each piece of personal information; kind is email, phone, id_number, address or name.

    Offsets are code points, the end is exclusive; spans of one text don't overlap. Defined results: null key or text: left
    out; empty text: nothing; rows repeated under one key with the same text: each place once; texts of any length are read whole. One pass without a shuffle,
    only the places found are made distinct; the model file is read by each Python worker.
    """
    return _texts(docs, key, text).mapInArrow(_spans(model, tokenizer), "doc_id long, kind string, start_at long, end_at long").distinct()


def redact_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text, replaced): each row's text with typed placeholders, and their number. Null key or text: left out."""
    return _texts(docs, key, text).mapInArrow(_replaced(model, tokenizer), "doc_id long, text string, replaced int")
