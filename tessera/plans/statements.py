"""A guard in front of SQL text: what a statement would do, told from its words outside of quotes and comments.

Closed by default: what isn't known to read is refused, and so is text that isn't one statement. Literals aren't kept.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

READ, METADATA, TRANSACTION = "READ_QUERY", "METADATA_QUERY", "TRANSACTION_CONTROL_ALLOWED"
ALLOWED = (READ, METADATA, TRANSACTION)
WRITES = frozenset("INSERT UPDATE DELETE MERGE REPLACE UPSERT".split())
DEFINITIONS = frozenset("CREATE ALTER DROP TRUNCATE REINDEX GRANT REVOKE ATTACH DETACH VACUUM".split())
CALLS = frozenset("CALL EXEC EXECUTE DO".split())
TRANSACTIONS = frozenset("BEGIN COMMIT ROLLBACK SAVEPOINT RELEASE".split())
LOOKS = frozenset("PRAGMA SHOW DESCRIBE DESC EXPLAIN".split())
PROCEDURES = frozenset(("LOAD_EXTENSION", "XP_CMDSHELL"))
CATALOGS = frozenset(("SQLITE_MASTER", "SQLITE_SCHEMA", "INFORMATION_SCHEMA", "SYS"))
SETTINGS = frozenset(("WRITABLE_SCHEMA", "LOAD_EXTENSION"))

#: One piece of a statement: the start of a comment, a quoted text or name, a word, or a single sign.
_PIECE = re.compile(r"""--[^\r\n]*|/\*|'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]\[]*\]|\$(\w*)\$.*?\$\1\$|\w+|\S""", re.S)


@dataclass(frozen=True)
class Decision:
    """What a statement is, whether it may run on a source, and why; the statement itself shows only as a digest."""

    kind: str
    reason: str
    fingerprint: str

    @property
    def allowed(self) -> bool:
        return self.kind in ALLOWED


def pieces(text: str) -> list[tuple[str, int]] | None:
    """(word or sign in capitals, depth of brackets) outside of comments and quotes; None if a quote, comment or bracket doesn't end.

    Comments may hold comments. Quoted names count as names: they are given as an empty word.
    """
    out: list[tuple[str, int]] = []
    at, depth = 0, 0
    while match := _PIECE.search(text, at):
        piece, at = match.group(), match.end()
        if piece.startswith("--"):
            continue
        if piece == "/*":
            at = _comment_end(text, at)
            if at < 0:
                return None
            continue
        if piece in "'\"`":
            return None  # a quote that doesn't end
        if len(piece) > 1 and piece[0] in "'\"`[$":
            out.append(("", depth))
            continue
        depth -= piece == ")"
        if depth < 0:
            return None
        out.append((piece.upper(), depth))
        depth += piece == "("
    return out if depth == 0 else None


def _comment_end(text: str, at: int) -> int:
    """The place after a comment's end, or -1."""
    open_comments = 1
    while open_comments:
        inner, end = text.find("/*", at), text.find("*/", at)
        if end < 0:
            return -1
        nested = 0 <= inner < end
        open_comments += 1 if nested else -1
        at = (inner if nested else end) + 2
    return at


def _followed(words: list[str], first: str, then: frozenset[str] | str) -> bool:
    return any(a == first and (b == then if isinstance(then, str) else b in then) for a, b in zip(words, words[1:], strict=False))


def _verbs(found: list[tuple[str, int]]) -> set[str]:
    """Words that stand where a statement or a part in brackets begins: at the start, after a bracket, or where brackets have closed before them."""
    verbs, before = set(), ""
    for piece, _ in found:
        if piece and (before in ("", "(", ")") and (piece in WRITES or piece in DEFINITIONS)):
            verbs.add(piece)
        before = piece if piece else "name"
    return verbs


def classify(text: str | None) -> Decision:
    """What a statement does. A write inside of WITH or of brackets is a write; a word in quotes, comments or a longer name is none."""
    source = text or ""
    fingerprint = "sha256:" + hashlib.sha256(source.encode("utf-8", "surrogatepass")).hexdigest()

    def told(kind: str, reason: str) -> Decision:
        return Decision(kind, reason, fingerprint)

    found = pieces(source)
    if found is None:
        return told("UNKNOWN", "a quote, comment or bracket doesn't end")
    while found and found[-1][0] == ";" and len(found) > 1 and found[-2][0] == ";":
        found.pop()
    if not found or any(p == ";" for p, _ in found):
        return told("MULTI_STATEMENT", "not exactly one statement")
    words = [p for p, _ in found]
    have, first = set(words), words[0]
    if have & {"ATTACH", "DETACH"} or _followed(words, "VACUUM", "INTO") or _followed(words, "PRAGMA", SETTINGS):
        return told("DDL", "attaches, exports or opens up a database")
    if have & {"OUTFILE", "DUMPFILE"} or (first == "COPY" and "TO" in have) or ("SELECT" in have and "INTO" in words[words.index("SELECT") :] and first not in WRITES and not _verbs(found) & WRITES):
        return told("FILESYSTEM_EXPORT", "writes what it reads to a file or table")
    if first in CALLS or have & PROCEDURES:
        return told("PROCEDURE_EXECUTION", "runs a procedure or extension")
    if first in DEFINITIONS:
        return told("DDL", "changes definitions or rights")
    if first in WRITES or (first in ("WITH", "(", "EXPLAIN") and _verbs(found) & WRITES):
        return told("WRITE_DML", "changes rows")
    if first in TRANSACTIONS:
        return told(TRANSACTION, "bounds a read-only session")
    if first in LOOKS or have & CATALOGS:
        return told(METADATA, "reads descriptions")
    if first in ("SELECT", "WITH", "VALUES", "(") and (first in ("SELECT", "VALUES") or have & {"SELECT", "VALUES"}):
        return told(READ, "reads rows")
    return told("UNKNOWN", "isn't known to read")


def classified(statement: Column) -> Column:
    """The kinds of a column of statements; a null one is no statement."""

    def kinds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: classify(t).kind)

    return F.pandas_udf(kinds, "string")(statement)
