"""Secret scan by assignment-aware lexing.

Source and configuration text is lexed into name-literal pairs: NAME = "x", name: x, "name": "x", name := x,
name => x, <name>x</name>. A right-hand side is a chain of terms joined by +: quoted literals (with escapes,
prefixes and triple quotes), names, calls, and bare configuration scalars. A call reaches to its balanced closing
parenthesis, however far; every literal in it, in calls within it too, is weighed on its own, and a single one is also
part of the chain. No literals are a mapping's keys and the names that an environment lookup reads. A call that is
never closed counts to the next empty line. Statements within a call are read as well, those within its literals not. Names
that were given a literal earlier in the text stand for it (constants are propagated through any number of
assignments and through concatenation and ${NAME}). A pair's score is the sensitivity of its name, from the
words it is made of, times the plausibility of the literal as a secret: length, character variety, entropy, and no
placeholder. Pairs with a score of LIMIT or more are findings; a finding covers every literal it was built from.

Defined results: null and empty texts have no finding. Repeated rows are scanned each. Names without a
sensitive word, placeholders and short or wordlike literals are no findings. `redact` keeps every row and column
(names may clash), replaces the literals of findings by MARK and leaves other texts as they are, nulls too.
Texts of any length are lexed whole, calls once each; time is linear in the length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm._shared import documents, only, slices

LIMIT = 0.5
MARK = "[SECRET]"

STATEMENT = re.compile(
    r"""(?<![\w$.\-])-*+(?:(?<=-)D(?=[A-Za-z_]))?+(?P<name>[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+)["'`]?\]?
    (?:[ \t]*:[ \t]*[A-Za-z_][\w\[\]|., ]*+(?=[ \t]*=[^=]))?
    [ \t]*+(?::=|=>|=(?![=~>])|:(?![:/=]))[ \t]*+""",
    re.X,
)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*+)>\s*+(?P<value>[^<>\n]++)\s*+</(?P=name)>")
QUOTED = re.compile(r"""[A-Za-z]{0,2}(?:\"\"\"(?P<a>(?s:.)*?)\"\"\"|'''(?P<b>(?s:.)*?)'''|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`\n]*+)`)""")
CALL = re.compile(r"(?:new\s+)?[A-Za-z_$][\w$.:]*+\s*+\(")
MARKS = re.compile(r"[()\"'`]")
KEY = re.compile(r"\s*+(?:=>|[:=](?![:=]))")
LOOKUP = re.compile(r"(?:getenv|environ\.get|\benv|getProperty)\s?\($", re.I)
EMPTY_LINE = re.compile(r"\n[ \t\r]*+(?=\n)")
NAME = re.compile(r"[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+")
BARE = re.compile(r"""[^\s,;'"`<>{}()\[\]]+""")
PLUS = re.compile(r"\s*\+\s*|[ \t]*\\?\n?[ \t]*(?=[\"'])")
FILLED = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\}")

STRONG = {"password", "passwd", "passphrase", "pwd", "pass", "secret", "secrets", "token", "apikey", "credential", "credentials", "creds", "bearer", "passcode", "authtoken", "privatekey", "secretkey", "accesskey", "jwt"}
KEYED = {"api", "access", "private", "secret", "signing", "encryption", "master", "auth", "account", "storage", "service", "client", "shared", "ssh", "aes", "hmac", "session", "app"}
#: Each weight, and the discount of earlier parts, lets a literal as plausible as a hexadecimal key (0.94) reach LIMIT.
WEAK = {"key": 0.55, "auth": 0.6, "authorization": 0.8, "salt": 0.6, "signature": 0.55, "sig": 0.55, "pin": 0.55, "cookie": 0.55, "session": 0.55, "dsn": 0.55, "cert": 0.55}
CALM = {"count", "counts", "limit", "length", "len", "size", "max", "min", "num", "hint", "policy", "type", "name", "field", "label", "url", "uri", "path", "file", "dir", "public", "expiry", "expires", "ttl", "format", "regex", "pattern", "prompt", "column", "header", "index", "enabled", "required", "tokenizer", "vocab", "id"}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|_+|0+|none|null|nil|true|false|undefined|todo|tbd|changeme|change[-_ ]?it|example|sample|dummy|test|testing|foo|bar|password|secret|token|your.*|my[-_]?(?:password|secret|token|key)|insert.*|enter.*|replace.*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|env\..*|process\.env.*)$", re.I)
SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    """0 to 1, from the words of the name's last part, or of an earlier part at a discount."""
    best, parts = 0.0, re.split(r"[.]", name)
    for back, part in enumerate(reversed(parts)):
        words = [w.lower() for w in SPLIT.findall(part)]
        joined = "".join(words)
        own = 1.0 if STRONG & set(words) or any(joined.endswith(s) for s in STRONG if len(s) > 4) else 0.0
        if not own:
            own = max([WEAK.get(w, 0.0) for w in words], default=0.0)
            if "key" in words and KEYED & set(words):
                own = 1.0
        if CALM & set(words):
            own *= 0.3
        best = max(best, own * (1.0 if back == 0 else 0.55))
    return best


def plausibility(literal: str) -> float:
    """0 to 1: how much the literal looks like a secret that somebody was given or chose."""
    n = len(literal)
    if n < 6 or PLACEHOLDER.match(literal) or len(set(literal)) < 4:
        return 0.0
    if any(c.isspace() for c in literal) and "-----BEGIN" not in literal:
        return 0.2 if n < 80 else 0.0
    counts = Counter(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = any(c.islower() for c in literal) + any(c.isupper() for c in literal) + any(c.isdigit() for c in literal) + any(not c.isalnum() for c in literal)
    score = 0.25 + 0.12 * kinds + 0.3 * min(1.0, entropy / 3.5) + 0.15 * min(1.0, n / 20)
    if literal.isalpha() and (literal.islower() or literal.istitle()):
        score *= 0.7
    if re.match(r"^(?:https?|s3|gs|file|hdfs)://[^@]*$|^[./~][\w./-]*$", literal):
        score *= 0.3
    return min(1.0, score)


Part = tuple[str, int, int]


#: Of a call: its end, and the literals of the pass that lexed it, with the first and the last of its own.
Call = tuple[int, list[Part], int, int]
#: Literals that count each on its own: a pass over calls, the first and the last of them.
Range = tuple[list[Part], int, int]
#: What a name stands for: the parts of its chain, and the literals of calls in it.
Value = tuple[list[Part], list[Range]]


def lex_call(text: str, opening: int, calls: dict[int, Call]) -> Call:
    """The call whose parenthesis is at `opening`; calls within it are noted in `calls` too, so nothing is lexed twice."""
    if opening in calls:
        return calls[opening]
    found: list[Part] = []
    stack, at = [(opening, 0)], opening + 1
    while stack and (m := MARKS.search(text, at)):
        at = m.end()
        if m[0] == "(":
            stack.append((m.start(), len(found)))
        elif m[0] == ")":
            begin, first = stack.pop()
            calls[begin] = at, found, first, len(found)
        elif q := QUOTED.match(text, m.start()):
            at, own = q.end(), (q[q.lastgroup], q.start(q.lastgroup), q.end(q.lastgroup))
            end = m.start()
            while end and text[end - 1].isspace():
                end -= 1
            before = text[max(0, end - 20) : end]  # longer than any call's name that LOOKUP has
            key = before[-1:] in "{,(" and KEY.match(text, at)
            if not key and not (LOOKUP.search(before) and NAME.fullmatch(own[0])):
                found.append(own)
    if stack:
        empty, starts = [m.start() for m in EMPTY_LINE.finditer(text, opening)], [p[1] for p in found]
        for begin, first in stack:
            k = bisect_left(empty, begin)
            stop = empty[k] if k < len(empty) else len(text)
            calls[begin] = stop, found, first, max(first, bisect_left(starts, stop))
    return calls[opening]


def side(text: str, at: int, known: dict[str, Value], calls: dict[int, Call]) -> tuple[list[Part], list[Range], int]:
    """(literal parts, literals of calls, end) of the right-hand side that begins at `at`; none where it isn't known."""
    parts: list[Part] = []
    alone: list[Range] = []
    while True:
        if m := QUOTED.match(text, at):
            g = m.lastgroup
            own = m[g]
            parts.append((own, m.start(g), m.end(g)))
            for f in FILLED.finditer(own):
                more = known.get(f[1] or f[2] or f[3], ([], []))
                parts += more[0]
                alone += more[1]
            at = m.end()
        elif m := CALL.match(text, at):
            at, found, first, last = lex_call(text, m.end() - 1, calls)
            if last > first:
                alone.append((found, first, last))
            if last - first == 1:
                parts.append(found[first])
        elif (m := NAME.match(text, at)) and m[0] in known:
            parts += known[m[0]][0]
            alone += known[m[0]][1]
            at = m.end()
        elif m := BARE.match(text, at):
            own = m[0].rstrip(".:!?&")
            if any(c.isdigit() for c in own) or not (own.isalnum() or NAME.fullmatch(own)):
                parts.append((own, m.start(), m.start() + len(own)))
            return parts, alone, m.end()
        else:
            return parts, alone, at
        joined = PLUS.match(text, at)
        if not joined or (joined.end() == at and not QUOTED.match(text, at)):
            return parts, alone, at
        at = joined.end()


Finding = tuple[str, int, int, float]


def scan(text: str) -> list[Finding]:
    """(name, start, end, score) of every literal of a finding, in order of start; each literal once, at its best score."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    known: dict[str, Value] = {}
    calls: dict[int, Call] = {}
    done: dict[tuple[int, float], tuple[int, int]] = {}

    def weigh(name: str, parts: list[Part]) -> None:
        own = sensitivity(name)
        if not own:
            return
        value = "".join(p[0] for p in parts)
        score = own * plausibility(value)
        if score >= LIMIT:
            for p, a, b in parts:
                if p and score > best.get((a, b), (0.0, ""))[0]:
                    best[a, b] = score, name

    def weigh_each(name: str, one: Range) -> None:
        """Weighs literals but those that a name as sensitive had before: calls within calls share theirs."""
        own, (found, first, last) = sensitivity(name), one
        if own:
            low, high = done.get((id(found), own), (first, first))
            for k in range(max(first, high) if low <= first else first, last):
                weigh(name, [found[k]])
            done[id(found), own] = (low, max(high, last)) if low <= first <= high else (first, last)

    if "=" in text or ":" in text:
        at = until = 0
        inside: list[Part] = []  # literals of the right-hand side with calls that reaches to `until`
        while m := STATEMENT.search(text, at):
            k = bisect_right(inside, m.start("name"), key=lambda p: p[1]) - 1
            if k >= 0 and m.end() <= inside[k][2]:
                at = max(inside[k][2], at + 1)
                continue
            parts, alone, end = side(text, m.end(), known, calls)
            name = m["name"]
            if parts or alone:
                alone = list({(id(one[0]), *one[1:]): one for one in alone}.values())
                known[name] = parts, alone
                weigh(name, parts)
                for one in alone:
                    weigh_each(name, one)
            else:
                known.pop(name, None)
            own = [one for one in alone if m.end() <= one[0][one[1]][1] and one[0][one[2] - 1][2] <= end]
            if own:
                if end > until:
                    literals = {p for found, first, last in own for p in found[first:last]}
                    inside, until = sorted(literals | {p for p in parts if m.end() <= p[1] and p[2] <= end}, key=lambda p: p[1]), end
                at = m.end()
            else:
                literal = parts and all(m.end() <= a and b <= end for _, a, b in parts)
                at = max(end if literal else m.end(), at + 1)
    if "</" in text:
        for m in ELEMENT.finditer(text):
            value = m["value"].rstrip()
            weigh(m["name"], [(value, m.start("value"), m.start("value") + len(value))])
    return [(name, a, b, score) for (a, b), (score, name) in sorted(best.items())]


def maybe(text: F.Column) -> F.Column:
    """True wherever the lexer could find a pair: all its forms have one of these."""
    return text.contains("=") | text.contains(":") | text.contains("</")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, name, start_at, end_at, masked, score) of all findings; places count characters from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                rows, out = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    for name, a, b, score in scan(text):
                        rows.append(k)
                        out.append((name, a, b, text[a : a + 4] + "*" * min(8, b - a - 4), round(score, 6)))
                cols = list(zip(*out)) if out else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "name", "start_at", "end_at", "masked", "score"])

    source = only(docs, id_col, text_col).filter(maybe(F.col("text")))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, name string, start_at long, end_at long, masked string, score double")


def clean(text: str | None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for _, a, b, _ in scan(text):
        if a >= at:
            out += [text[at:a], MARK]
            at = b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the literals of findings replaced in the text; all rows and columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_col):
                k = part.schema.get_field_index(text_col)
                new = pa.array([clean(t) for t in part.column(k).to_pylist()], part.schema.field(k).type)
                yield pa.RecordBatch.from_arrays([new if i == k else part.column(i) for i in range(part.num_columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(documents(spark, sf_dir))
