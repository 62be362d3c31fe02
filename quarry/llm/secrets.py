"""Credentials in code, config, commands and tool input: unnatural strings, context rules, offset-preserving redaction."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import spread

#: A vocabulary of byte pairs with ranks, one "base64 rank" a line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which that public vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters per subword: words and identifiers have more, keys and generated passwords fewer.
UNNATURAL, VERY_UNNATURAL, PLAIN = 2.6, 1.9, 5.6

# Words that name a secret when a name ends with them.
_NAMES = r"pass(?:word|wd|phrase|code|key)?|pwd|pw|secret|token|key|credentials?|bearer|api[-_. ]?key|(?:access|secret|signing|encryption|private|master|auth|account|shared|session|deploy|license|service|client|app|write|hmac|sas|storage|subscription)[-_. ]?key|auth|jwt|pat|pin|dsn[-_]?password|signature|sig"
#: A name that ends with a secret word, then a sign of assignment, then the value.
_ASSIGNED = re.compile(rf"(?i)(?P<name>{_NAMES})(?P<sep>\\?[\"'`]?\]?[ \t]*+(?:\?\?=|\|\|=|:=|=>|==?|:)[ \t]*+)(?P<rest>\S)")
_SAID = re.compile(r"(?i)\b(?P<name>pass(?:word|wd|phrase|code)|pwd|pw)(?P<sep>[ \t]+(?:(?:is|was|of|to)[ \t]+)?)(?=[\"'`“]|\S*[^\sA-Za-z,.;:!?)])(?P<rest>\S)")
#: Prose that names a secret and quotes it, or says what it is or reads.
_QUOTED = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase|code)|pwd|pw|creds?|credentials?|secret|token|(?:api|access|signing)[ -]key)\b[^\n\"'`“”]{0,70}?[\"'`“](?P<value>[^\s\"'`“”]{6,}+)[\"'`”]")
_READS = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase|code)|pwd|pw|creds?|credentials?|secret|token|(?:api|access|signing)[ -]key)\b[^\n\"'`“”:={}]{0,70}?\b(?:is|was|reads|read|becomes|now)[ \t]+(?P<value>[^\s\"'`“”]{6,})")
_NOTED = re.compile(r"(?i)\b(?P<name>(?:api |access |old |new |secret )?(?:key|token|secret|credential)\b[^\n:={}()\[\]\"'`]{1,40}(?:\bis|\bwas|:)|(?:key|token|secret) (?:is|was))(?P<sep>[ \t]+)(?P<rest>[^\s\"'`])")
_FLAG = re.compile(rf"(?i)(?<!\S)(?P<name>--?[\w-]*?(?:{_NAMES}))(?P<sep>\s+)(?P<rest>[^\s-])")
_HEADER = re.compile(r"(?i)\b(?P<name>(?:proxy-)?authorization|x-[\w-]*(?:auth|token|key))\\?[\"'`]?(?P<sep>\s*[:=,]\s*)\\?[\"'`]?(?:(?:bearer|basic|token|digest|apikey|key)\s+)?(?P<rest>\S)")
_SCHEME = re.compile(r"(?P<name>\b(?:[Bb]earer|BEARER|Basic))(?P<sep>\s+)(?P<rest>[A-Za-z0-9+/=_.~*!#%&^?-]{8})")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\s:@/\"'`<>]*+:(?P<value>[^\s/\"'`<>]+)@(?=[\w\[$%{.-])")
_SIGNED = re.compile(r"(?i)[?&;](?:x-[a-z]+-(?:signature|credential-secret|security-token)|sig|signature|hmac|token|access_token|api_?key|key|auth)=(?P<value>[^\s&\"'`<>)\];]{8,})")
_PAIR = re.compile(r"(?i)\b(?:auth|credentials?|login|basic_auth)\s*[=:]\s*[(\[]\s*[\"'][^\"'\n]*+[\"']\s*,\s*(?P<q>[\"'])(?P<value>[^\"'\n]{3,}+)(?P=q)")
#: "-u user:password" of a command; "login user / password"; a comment that names the next string.
_LOGIN = re.compile(r"(?:(?<=\s)(?:-u|--user|--proxy-user)(?:\s+|=)[\"']?[\w.@+-]++:|\b[Cc]red(?:s|entials)?\b[^\n:=]{0,60}:[ \t]*[\w.@+-]++:[\"'`]?|\b[Ll]og(?:in|ged in)(?: as)? [\w.@+-]++ ?/ ?[\"'`]?|(?i:/\*\s*pass(?:word|wd|phrase)?\s*\*/)\s*[\"'`])(?P<value>[^\s\"'`]{4,})")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
#: What stands between the armor lines of a key without an END line, and one such line; short ones must not look like a word.
_ARMOR_GAP = re.compile(r"(?:\\+[nrt]|[\s\"'`+,;|>#*()]|//(?=\s)|(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): [^\n\\]*)*+")
_ARMOR = re.compile(r"[A-Za-z0-9+/=]{20,}+|[A-Za-z]*[0-9+/=][A-Za-z0-9+/=]*+|[A-Za-z]*[a-z][A-Z][A-Za-z]*+|[A-Za-z]+\Z")
#: Vendors mark their keys: a short lower-case tag, a separator, and an unnatural body.
_TAGGED = re.compile(r"(?<![\w/.+@:-])(?P<value>(?:[a-z]{2,6}(?:_(?:live|test|pat|prod|sk|pk|key))?[_-]|[a-z]{2}\d[a-z]?[.-]|eyJ[A-Za-z0-9_-]{8,}\.|AKIA|ASIA|AIza)[A-Za-z0-9_.-]{16,})(?![\w/+-])")
#: What every rule but _TAGGED needs: the words they begin with, of short ones with what must follow.
_CUE = re.compile(r"(?i)pass|pwd|\bpw\b|-u\b|-user\b|log(?:in|ged in)[\s=:]|secret|token|key|auth|bearer|basic|cred|jwt|://|[?&;](?:x-|sig|hmac)|(?:pw|pat|pin|sig|signature)\\?[\"'`]?\]?[ \t]*+[?|:=]|(?<!\S)-[\w-]*?(?:pw|pat|pin|sig|signature)\s")

#: Contexts that leave no doubt; without one, a text of natural strings has no secret.
_STRONG = re.compile(r"(?i)pass|pwd|\bpw\b|pw\\?[\"'`]?\]?[ \t]*+[?|:=]|://|-u\b|-user\b|login|logged|auth|bearer|basic|cred|secret|token|key|jwt|(?:pat|pin|sig|hmac|signature)\b|PRIVATE KEY")
#: Strings that the vocabulary is asked about, and the words before them that say what they are instead.
_STRING = re.compile(r"[A-Za-z0-9+/_.~!#%^$@-]{12,}+=*")
_NOT_SECRET = re.compile(r"(?i)(?:sha-?\d*|md5|crc|commit|hash|digest|checksum|integrity|etag|uuid|guid|\w*id|ids|trace|span|request|build|version|revision|rev|blob|object|fingerprint|public|pub|ssh-(?:rsa|ed25519)|nonce|cursor|serial|image|layer|tree|parent|ref|path|url|file|href|src|sum|signed-off-by|cache|snapshot|index|certificate|cert)\W{0,6}$")
_OPEN = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’"}
_BARE_END = re.compile(r"[\s\"'`,;)\]}<>|“”\\]")
_KV_END = re.compile(r"[\s\"'`\\]|[,;](?=\s|$|[\w ]{1,40}=)")
_REFERENCE = re.compile(
    r"(?ix)^(?: \$[\w({\[] .* | %\(\w+\)s? | %\w+% | %s | \{\{ .* | <[^>]*>? | \#\{.* | !\w.* | \*+ .* | @[\w.]+\( .* | env[.:(\[] .* | vault[:/.] .* | arn: .* | ref\+ .* | secret[s:]/ .* | file: .* | "
    r"(?:process\.env|os\.(?:environ|getenv)|import\.meta|system\.getenv|config|settings|secrets?|vault|ssm|kms|keyring|self|this|args|opts|options|params|req|request|ctx|credentials?)\s*[.\[(] .* | [/~.]{1,2}/ .* | /[\w.-]+/ .* | [\w.]+\( .* )$"
)
_PLACEHOLDER = re.compile(
    r"(?ix)^(?: null|nil|none|undefined|true|false|yes|no|on|off|string|str|bytes|number|int|bool(?:ean)?|text|any|object|required|optional|empty|unset|default|example | "
    r"(?:.*[-_. ])?(?:redacted|masked|hidden|removed|placeholder|change[-_. ]?me|replace[-_. ]?me|fill[-_. ]?me|todo|fixme|dummy|sample|insert|your)(?:[-_. ].*)? | "
    r"your.* | my[-_]?(?:password|secret|token|key) | x{3,} | [x*.•#_\-]{3,} | \.{2,} | 0+ | 1234?5?6?7?8?9?0? | "
    r"(?:.*[-_])?(?:pass(?:word|wd|phrase)?|secret|token|api[-_]?key|key|bearer|basic|credentials?) | .*[x*•]{6,}.* | .*\.\.\. )$"
)
_NUMBER = re.compile(r"^[\d.,]+(?:[a-z]{1,3})?$")
_HEX_SUM = re.compile(r"(?i)^(?:sha\d*|md5|sha256)[:-]")
_WORDY = re.compile(r"^[a-z]+$|^[A-Z]?[a-z]+(?:[A-Z][a-z]+)*$|^[A-Z_]+$")


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def armor_end(text: str, at: int) -> int:
    """Where the armor lines that follow an opening line end; `at` if none follows."""
    end = at
    while m := _ARMOR.match(text, _ARMOR_GAP.match(text, end).end()):
        end = m.end()
    return end


class Finder:
    """Finds secrets in texts; the rules see the context, the vocabulary sees how natural a string is."""

    def __init__(self, tokenizer: str = TOKENIZER):
        self.encode = _encoding(tokenizer).encode_ordinary
        self.known = lru_cache(maxsize=50_000)(self._rate)

    def _rate(self, value: str) -> float:
        return len(value) / max(1, len(self.encode(value)))

    def rate(self, value: str) -> float:
        return self.known(value) if len(value) <= 1000 else self._rate(value)

    def unnatural(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, rate) of every string of the text that has few characters per subword."""
        known, out = self.known, []
        for m in _STRING.finditer(text):
            value = m[0]
            rate = known(value) if len(value) <= 1000 else self._rate(value)
            if rate < UNNATURAL:
                out.append((m.start(), m.end(), rate))
        return out

    def bare(self, text: str, start: int, end: int, rate: float) -> bool:
        """Whether an unnatural string that nothing names is a key: mixed characters in one run or behind a vendor's tag, and no word before it that says otherwise."""
        value = text[start:end]
        if not (any(map(str.isdigit, value)) and any(map(str.isupper, value))) or _PLACEHOLDER.match(value) or _HEX_SUM.match(value) or value.endswith((".test", ".example", ".invalid")):
            return False
        if start and text[start - 1] in "\\:=&?(" or text[end : end + 1] in ("(", ":", "@", "\\"):
            return False
        if _TAGGED.match(text, start, end):
            return True
        if rate >= VERY_UNNATURAL or len(value) < 20 or not any(map(str.islower, value)) or any(c in value for c in ".~!#%^$@") or value.count("/") > len(value) // 24:
            return False
        return not _NOT_SECRET.search(text, max(text.rfind("\n", 0, start) + 1, start - 40), start)

    def judged(self, kind: str, value: str) -> bool:
        """Whether a value in a context of this kind is a secret written out: the weaker the context, the less natural the value must be."""
        if len(value) < 4 or ("\n" not in value[:-1] and _PLACEHOLDER.match(value)) or _REFERENCE.match(value) or _NUMBER.match(value) or _HEX_SUM.match(value):
            return False
        rate = self.rate(value)
        if kind in ("password", "url", "pair", "header"):  # the context leaves no doubt, unless the value is a word of the language
            return rate < (PLAIN if len(value) >= 6 else UNNATURAL)
        if kind == "said":  # prose: plainly no word
            mixed = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", r"\d", r"[^\w]|_")) > 3
            return rate < (UNNATURAL + 1 if mixed else UNNATURAL) and bool(re.search(r"\d|[A-Z]\w*[!*%^+#?]", value) or value.count("-") >= 2)
        if kind == "weak":  # names such as token or key, which also name other things
            return len(value) >= 8 and (rate < (VERY_UNNATURAL if value.isalpha() and value.islower() else UNNATURAL) or value.count("-") >= 3 and rate < PLAIN)
        if kind == "noted":
            return len(value) >= 12 and (rate < VERY_UNNATURAL or value.count("-") >= 3 and rate < PLAIN) and not value.islower()
        return len(value) >= 12 and rate < UNNATURAL  # signed

    def value_at(self, text: str, at: int, sep: str) -> tuple[int, int]:
        """Bounds of the value that starts at `at`, without its quotes."""
        escaped = text[at] == "\\" and text[at + 1 : at + 2] in ("\"", "'")
        if escaped:
            end = text.find(text[at : at + 2], at + 2)
            return (at + 2, end) if end > 0 else (at + 2, at + 2)
        for prefix in ("b", "r", "f", "u", "B"):
            if text.startswith(prefix, at) and text[at + 1 : at + 2] in ("'", '"'):
                if prefix == "f" and "{" in text[at : text.find("\n", at) % (len(text) + 1)][:200]:
                    return at, at
                at += 1
                break
        close = _OPEN.get(text[at])
        if close:
            for triple in ('"""', "'''"):
                if text.startswith(triple, at):
                    end = text.find(triple, at + 3)
                    return (at + 3, end) if end > 0 else (at, at)
            end = at + 1
            while end < len(text) and text[end] != close and text[end] != "\n":
                end += 2 if text[end] == "\\" else 1
            if end < len(text) and text[end] == close:
                return at + 1, end
            at += 1
        m = (_KV_END if ":" in sep and not sep.endswith(" ") or "=" in sep else _BARE_END).search(text, at)
        return at, m.start() if m else len(text)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of each secret, in order, none inside another."""
        found: dict[int, tuple[int, str]] = {}

        def add(start: int, end: int, kind: str) -> None:
            if end > start and found.get(start, (0, ""))[0] < end:
                found[start] = end, kind

        strange = self.unnatural(text)
        if strange or _STRONG.search(text):
            if _CUE.search(text):
                self.named(text, add)
            for start, end, rate in strange:
                if self.bare(text, start, end, rate):
                    add(start, end, "key")
        out: list[tuple[int, int, str]] = []
        for start, (end, kind) in sorted(found.items(), key=lambda x: (x[0], -x[1][0])):
            if not out or start >= out[-1][1]:
                out.append((start, end, kind))
        return out

    def named(self, text: str, add: Callable[[int, int, str], None]) -> None:
        """Adds the secrets that something beside them names."""
        keys = list(_PRIVATE.finditer(text))
        ends = [m.span() for m in _PRIVATE_END.finditer(text)] if keys else []
        for m, after in zip(keys, [*(n.start() for n in keys[1:]), len(text)]):
            i = bisect_left(ends, (m.end(), 0))
            add(m.start(), ends[i][1] if i < len(ends) and ends[i][1] <= after else armor_end(text, m.end()), "private_key")
        for m in _URL.finditer(text):
            if self.judged("url", m["value"]):
                add(*m.span("value"), "url_password")
        for m in _SIGNED.finditer(text):
            if self.judged("signed", m["value"]):
                add(*m.span("value"), "signed_url")
        for m in _PAIR.finditer(text):
            if self.judged("pair", m["value"]):
                add(*m.span("value"), "password")
        for rule in (_QUOTED, _READS):
            for m in rule.finditer(text):
                if self.judged("said", m["value"]):
                    add(*m.span("value"), "password")
        for m in _LOGIN.finditer(text):
            if self.judged("pair", m["value"]):
                add(*m.span("value"), "password")
        for m in _HEADER.finditer(text):
            start, end = self.value_at(text, m.start("rest"), " ")
            if self.judged("header", text[start:end]):
                add(start, end, "authorization")
        for m in _SCHEME.finditer(text):
            start, end = self.value_at(text, m.start("rest"), " ")
            if self.judged("weak", text[start:end]):
                add(start, end, "authorization")
        for rule in (_ASSIGNED, _FLAG, _SAID, _NOTED):
            for m in rule.finditer(text):
                name, before = m["name"], text[m.start() - 1 : m.start()]
                strong = bool(re.match(r"(?i)-{0,2}.*(?:pass(?:word|wd|phrase|code)?|pwd|pw)$", name))
                if rule is _ASSIGNED and before.isalpha() and not (before.islower() and name[0].isupper()) and not (name.lower().startswith(("passw", "passp", "secret", "token", "api")) and name.isupper() == before.isupper()):
                    continue
                if rule is _ASSIGNED and before in ("?", "&") and before:
                    continue  # a parameter of a URL
                start, end = self.value_at(text, m.start("rest"), m["sep"])
                value = text[start:end]
                if value[:1] in ("(", "[", "{"):
                    continue
                while value and value[-1] in ",;:.)" and rule is not _ASSIGNED:
                    value = value[:-1]
                scheme = re.match(r"(?i)(?:bearer|basic|token)\s+", value)
                if scheme:
                    start, value = start + scheme.end(), value[scheme.end() :]
                kind = "said" if rule is _SAID else "noted" if rule is _NOTED else "password" if strong else "weak"
                if "PRIVATE KEY" in value or "PUBLIC KEY" in value or value.startswith("-----"):
                    continue
                u = re.search(r"://[^\s:@/]*:([^\s/]+)@", value)
                if u or value.startswith(("http://", "https://")):
                    continue
                if self.judged(kind, value):
                    add(start, start + len(value), "password" if strong else "key")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with every character of the spans replaced by '*', line breaks kept, so that all offsets stay."""
    out, at = [], 0
    for start, end, _ in spans:
        out.append(text[at:start])
        out.append("".join(c if c in "\r\n" else "*" for c in text[start:end]))
        at = end
    return "".join([*out, text[at:]])


def _scanner(tokenizer: str, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(tokenizer)
        for batch in batches:
            keys, starts, ends, kinds, texts, counts = [], [], [], [], [], []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans = finder.find(text)
                if redact:
                    keys.append(key)
                    texts.append(masked(text, spans) if spans else text)
                    counts.append(len(spans))
                else:
                    for start, end, kind in spans:
                        keys.append(key)
                        starts.append(start)
                        ends.append(end)
                        kinds.append(kind)
            if redact:
                columns = [pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "text", "secrets"])
            else:
                columns = [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "start_at", "end_at", "kind"])

    return run


def _texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return spread(rows.select(F.col(key).cast("long").alias("row_id"), F.col(text).alias("text")).dropna())


def find_secrets(rows: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(row_id, start_at, end_at, kind) of each secret written out in the text; offsets are code points, the end is exclusive.

    Defined results: null key or text: left out; empty text: nothing; rows stored twice under one key with the same text: each
    place once; the same secret at several places: each place; texts and values of any length are read whole; a private key
    without an END line ends with its armor lines. Words that name a secret in prose count from at most 70 characters before
    it. One pass without a shuffle; only the places found are made distinct.
    """
    return _texts(rows, key, text).mapInArrow(_scanner(tokenizer, False), "row_id long, start_at long, end_at long, kind string").distinct()


def redact_secrets(rows: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(row_id, text, secrets): each row's text with secrets masked character by character, and their number.

    Quotes, names, line breaks and all offsets stay, so code still parses. Null key or text: left out; rows repeated: repeated.
    """
    return _texts(rows, key, text).mapInArrow(_scanner(tokenizer, True), "row_id long, text string, secrets int")
