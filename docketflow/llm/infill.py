r"""Fill-in-middle transformation on piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its text and the sentinels.
Cutting splits descriptors, an arrangement permutes the cut pieces and puts sentinel descriptors between them, the
inverse permutation puts them back. No text is copied until a result is wanted; hashes read the descriptors in turn, in
stretches of CHUNK characters.

A text is cut into n tokens, each a run of non-blank characters with the blanks (space, \t to \r) before it, or the
blanks that end the text. The choices follow from the sha256 of ``seed:doc_id`` alone: h1 to h4 are its first four groups
of eight digits. The prefix ends after the smaller of h1 % (n+1) and h2 % (n+1) tokens, the middle after the larger. A
text is left plain if it is empty, holds a sentinel, or h3 % 100 >= ``rate``; else h4 % 100 < ``spm_rate`` picks
``<S>suffix<P>prefix<M>middle`` (spm) over ``<P>prefix<S>suffix<M>middle`` (psm).

A null text counts as empty; a null id as the empty string. Repeated ids and rows get the same choices. An empty table
stays one. ``transform`` keeps all columns and replaces those it makes, if there are any of these names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.llm.rows import map_rows

TEXT, SIGNS = 0, 1
SENTINELS = "<P><S><M>"
PREFIX, SUFFIX, MIDDLE = (SIGNS, 0, 3), (SIGNS, 3, 3), (SIGNS, 6, 3)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: For each form the pieces (0 prefix, 1 middle, 2 suffix) in order, each behind its sentinel.
ARRANGEMENTS = {PSM: ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), SPM: ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
SEED = 42
RATE = 50
SPM_RATE = 80
CHUNK = 1 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HOLDS_SIGN = re.compile("<[PSM]>")
_BLANKS = " \t\n\v\f\r"

Descriptor = tuple[int, int, int]


@dataclass(frozen=True)
class PieceTable:
    """Descriptors over a text and the sentinels."""

    text: str
    pieces: tuple[Descriptor, ...]

    @classmethod
    def of(cls, text: str) -> PieceTable:
        return cls(text, ((TEXT, 0, len(text)),) if text else ())

    def cut(self, *places: int) -> list[tuple[Descriptor, ...]]:
        """The descriptors before the first place, between the places, and behind the last; places ascend."""
        parts, part, at, left = [], [], 0, list(places)
        for buffer, start, size in self.pieces:
            while left and left[0] < at + size:
                step = left.pop(0) - at
                if step:
                    part.append((buffer, start, step))
                parts.append(tuple(part))
                part, at, start, size = [], at + step, start + step, size - step
            part.append((buffer, start, size))
            at += size
        parts += [tuple(part), *[() for _ in left]]
        return parts

    def arranged(self, form: str, first: int, second: int) -> PieceTable:
        """Cut at the two places, permuted and with sentinels, as the form says."""
        if form == PLAIN:
            return self
        parts = self.cut(first, second)
        return PieceTable(self.text, tuple(d for sign, which in ARRANGEMENTS[form] for d in (sign, *parts[which])))

    def chunks(self) -> Iterator[str]:
        for buffer, start, size in self.pieces:
            source = SENTINELS if buffer == SIGNS else self.text
            for at in range(start, start + size, CHUNK):
                yield source[at:min(at + CHUNK, start + size)]

    def render(self) -> str:
        return "".join(self.chunks())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.chunks():
            digest.update(part.encode())
        return digest.hexdigest()


def restored(output: str, form: str) -> PieceTable:
    """The original text as descriptors over an output.

    The sentinels are found from the left: neither a piece nor a piece and its neighbour can hold one, since a sentinel
    has its only ``<`` in front and its only ``>`` at the end.
    """
    if form == PLAIN:
        return PieceTable.of(output)
    spans, at = {}, 0
    order = ARRANGEMENTS[form]
    for i, ((_, sign, size), which) in enumerate(order):
        start = at + size
        if i + 1 < len(order):
            _, after, width = order[i + 1][0]
            at = output.index(SENTINELS[after:after + width], start)
        else:
            at = len(output)
        spans[which] = (TEXT, start, at - start)
    return PieceTable(output, tuple(spans[i] for i in range(3) if spans[i][2]))


def tokens_and_places(text: str, first: int, second: int) -> tuple[int, int, int]:
    """n, and the characters before the ends of the prefix and of the middle, from two hashes."""
    ends = [m.end() for m in _WORD.finditer(text)]
    if text and text[-1] in _BLANKS:
        ends.append(len(text))
    one, two = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    return len(ends), ends[one - 1] if one else 0, ends[two - 1] if two else 0


def arrange(key, text: str | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int, int, PieceTable]:
    """n, form, the two places and the arranged piece table of a document."""
    text = text or ""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i:i + 8], 16) for i in range(0, 32, 8))
    n, one, two = tokens_and_places(text, h1, h2)
    plain = not text or h3 % 100 >= rate or _HOLDS_SIGN.search(text) is not None
    form = PLAIN if plain else SPM if h4 % 100 < spm_rate else PSM
    return n, form, one, two, PieceTable.of(text).arranged(form, one, two)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> DataFrame:
    """All columns, with ``fim_text``, ``fim_form`` and ``fim_pieces``: the descriptors (buffer 0 text, 1 sentinels)."""
    def work(one, value):
        _, form, _, _, table = arrange(one, value, seed, rate, spm_rate)
        return table.render(), form, [dict(zip(("buffer", "start", "length"), d)) for d in table.pieces]

    made = ["fim_text", "fim_form", "fim_pieces"]
    others = [c for c in docs.columns if c not in made]
    given = docs.select(F.struct(*others).alias("row"), F.col(key).alias("key"), F.col(text).alias("value"))
    out = map_rows(given, work, "fim_text string, fim_form string, "
                   "fim_pieces array<struct<buffer: int, start: int, length: int>>", keep=True)
    return out.select("row.*", *made)


def restore(docs: DataFrame, text: str = "fim_text", form: str = "fim_form", name: str = "restored") -> DataFrame:
    """All columns, with the original text rebuilt from an output and its form; null stays null."""
    def work(output, kind):
        return (None if output is None else restored(output, kind or PLAIN).render(),)

    others = [c for c in docs.columns if c != name]
    given = docs.select(F.struct(*others).alias("row"), F.col(text).alias("output"), F.col(form).alias("form"))
    return map_rows(given, work, f"{name} string", keep=True).select("row.*", name)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
            spm_rate: int = SPM_RATE) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, n_pieces of every row; no output leaves its task."""
    def work(one, value):
        n, form, first, second, table = arrange(one, value, seed, rate, spm_rate)
        back = restored(table.render(), form)
        sizes = (None, None) if form == PLAIN else (first, second - first)
        return n, form, *sizes, table.sha256(), back.sha256(), len(table.pieces)

    given = docs.select(F.col(key).alias("same"), F.col(key).alias("key"), F.col(text).alias("value"))
    out = map_rows(given, work, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
                   "restored_sha256 string, n_pieces int", keep=True)
    return out.withColumnRenamed("same", key)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || s[1:8] AS UBIGINT) AS h1, CAST('0x' || s[9:16] AS UBIGINT) AS h2,
    CAST('0x' || s[17:24] AS UBIGINT) AS h3, CAST('0x' || s[25:32] AS UBIGINT) AS h4 FROM d),
c AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS made FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(made) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN made
    WHEN 'psm' THEN made[4:strpos(made, '<S>') - 1] || made[strpos(made, '<M>') + 3:] || made[strpos(made, '<S>') + 3:strpos(made, '<M>') - 1]
    ELSE made[strpos(made, '<P>') + 3:strpos(made, '<M>') - 1] || made[strpos(made, '<M>') + 3:] || made[4:strpos(made, '<P>') - 1] END) AS restored_sha256,
  CAST(CASE WHEN t = '' THEN 0 WHEN form = 'plain' THEN 1
    ELSE 3 + CAST(pre <> '' AS INT) + CAST(mid <> '' AS INT) + CAST(suf <> '' AS INT) END AS INT) AS n_pieces
FROM o
"""
