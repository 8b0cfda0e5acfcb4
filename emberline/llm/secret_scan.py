"""Secret scanning: an Aho-Corasick pass finds keywords, anchored expressions run only there, and checksums settle what they can.

One base kind, runs of hexadecimal digits, has no keyword to be found by: it alone is searched for by its expression over the whole text.
Tokens that carry a check of their own must pass it: CRC-32 in six base-62 digits (GitHub and npm tokens), a header that decodes to an object
with an algorithm (web tokens), a length that fits its contents (private keys in PEM).

Defined cases: a null text counts as empty and has no findings; texts are scanned whole, however long; of one kind findings are leftmost and
do not overlap, findings of different kinds may; ties of a start go by the order of the kinds; equal rows give equal rows; an empty table
gives no rows; columns of any other name are ignored by ``find_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.arrow import arrow_pass
from emberline.session import table

ASSIGN, ACCESS, HEX, GITHUB, NPM, JWT, PEM = "assign", "access", "hex", "github", "npm", "jwt", "pem"
#: Kinds in the order in which they are listed for one start.
KINDS = [ASSIGN, ACCESS, HEX, GITHUB, NPM, JWT, PEM]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", re.ASCII)
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", re.ASCII)
_JWT = re.compile(r"(?<![0-9A-Za-z_-])(eyJ[0-9A-Za-z_-]+)\.([0-9A-Za-z_-]{2,})\.[0-9A-Za-z_-]{16,}", re.ASCII)
_PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----\s+([0-9A-Za-z+/=][0-9A-Za-z+/=\s]*?)-----END \1PRIVATE KEY-----", re.ASCII)
#: Lower-cased keywords with the kind that they may begin.
_KEYWORDS = {"password": ASSIGN, "passwd": ASSIGN, "secret": ASSIGN, "token": ASSIGN, "apikey": ASSIGN, "api_key": ASSIGN, "akia": ACCESS} | {f"gh{c}_": GITHUB for c in "pousr"} | {"npm_": NPM, "eyj": JWT, "-----begin ": PEM}
_LOWER = {c: c + 32 for c in range(65, 91)}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def checksum62(body: str) -> str:
    """Six base-62 digits of the CRC-32 of ``body``, as some token formats end in."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _decoded(body: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def web_token_holds(header: str, claims: str) -> bool:
    """Both parts are objects, and the first names an algorithm."""
    try:
        head, rest = (json.loads(_decoded(x) or b"") for x in (header, claims))
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(rest, dict) and "alg" in head


def key_holds(body: str) -> bool:
    """A DER sequence whose length is that of its contents, or the format of OpenSSH."""
    try:
        der = base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if der.startswith(b"openssh-key-v1\0"):
        return True
    if len(der) < 4 or der[0] != 0x30:
        return False
    n = der[1] & 0x7F
    return len(der) == (2 + der[1] if der[1] < 0x80 else 2 + n + int.from_bytes(der[2 : 2 + n], "big"))


#: Expression and check of the kinds that carry their own.
_CHECKED = {GITHUB: (_GITHUB, lambda m: checksum62(m[1]) == m[2]), NPM: (_NPM, lambda m: checksum62(m[1]) == m[2]), JWT: (_JWT, lambda m: web_token_holds(m[1], m[2])), PEM: (_PEM, lambda m: key_holds(m[2]))}


def scan(text: str | None, found: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, in the listed order."""
    if not text:
        return []
    out, past = [], dict.fromkeys(KINDS, 0)
    for last, (size, kind) in found.iter(text.translate(_LOWER) if not text.isascii() else text.lower()):
        at = last - size + 1
        if at < past[kind]:
            continue
        if kind == ASSIGN:
            if m := _ASSIGN.match(text, at):
                past[kind] = m.end()
                if len(m[2]) >= 8:
                    out.append((at, m.end(), kind))
        elif kind == ACCESS:
            if m := _ACCESS.match(text, at):
                past[kind] = m.end()
                if m.end() - at >= 16:
                    out.append((at, m.end(), kind))
        elif (m := _CHECKED[kind][0].match(text, at)) and _CHECKED[kind][1](m):
            past[kind] = m.end()
            out.append((at, m.end(), kind))
    out += [(m.start(), m.end(), HEX) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans): an array of start, end, kind and value per row; positions in code points, ends exclusive."""
    kind = dict(docs.dtypes)[key]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for b in batches:
            spans = [[{"start": s, "end": e, "kind": k, "value": t[s:e]} for s, e, k in scan(t, found)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, span)], [key, "spans"])

    return arrow_pass(docs.select(key, F.col(text).cast("string")), run, f"`{key}` {kind}, spans array<struct<start:int,end:int,kind:string,value:string>>")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with every finding replaced by its kind in brackets."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for b in batches:
            at, done = b.schema.get_field_index(text), []
            for t in b.column(at).to_pylist():
                end, parts = 0, []
                for s, e, k in scan(t, found):
                    if e > end:
                        parts += [t[end : max(s, end)], f"[{k}]"]
                        end = e
                done.append(t if t is None else "".join(parts) + t[end:])
            yield b.set_column(at, b.schema.field(at), pa.array(done, b.schema.field(at).type))

    return arrow_pass(docs, run, schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(ASSIGN, ACCESS, HEX))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", count(ASSIGN).alias("n_assign"), count(ACCESS).alias("n_access"), count(HEX).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
