"""Text that was decoded with the wrong character encoding (problem 6).

Records are cut into segments (lines, sentences, quoted names); segments made of everyday characters
are left alone. For the others a multinomial classifier over hashed byte bigrams names the exact
chain of encodings. It is trained on the spot: a bounded sample of the data's own clean segments is
garbled with every chain. Classes are taken in the order of their likelihood: where clean text comes
first, the segment is clean; a chain is inverted, and if every step decodes strictly and the result reads
like the clean sample, that is the restored text; else the chain cannot have made the segment and the next
likely class is asked. Chains that lose bytes leave replacement characters and give no restored text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_batches

#: Rows of the training sample, taken by smallest hash of the text; bounds the driver's work.
TRAIN_ROWS = 1500
FEATURES = 1 << 14
#: A chain must be likelier than clean text by this much (natural logarithm of the ratio).
MARGIN = 6.0

# Fixed values: (written in, read as) steps; two pairs are two mistakes in a row. Mistakes between two
# one-byte encodings are left out: any text can be taken back through them, so nothing verifies them.
CHAINS = [
    (("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp949"),), (("utf-8", "gbk"),), (("utf-8", "big5"),),
    (("utf-8", "shift_jis"),), (("utf-8", "euc_jp"),), (("utf-8", "cp437"),), (("utf-8", "cp850"),), (("utf-8", "mac_roman"),), (("utf-8", "cp1251"),),
    (("utf-8", "koi8_r"),), (("utf-8", "cp1250"),), (("cp949", "cp1252"),), (("cp949", "latin-1"),), (("cp949", "gbk"),), (("cp949", "big5"),), (("cp949", "shift_jis"),),
    (("cp949", "mac_roman"),), (("cp949", "cp1251"),), (("cp949", "cp437"),), (("cp949", "utf-8"),), (("cp1252", "utf-8"),),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "latin-1"), ("utf-8", "latin-1")), (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    (("utf-8", "cp1252"), ("utf-8", "latin-1")), (("cp949", "cp1252"), ("utf-8", "cp1252")), (("cp949", "latin-1"), ("utf-8", "latin-1")), (("cp949", "latin-1"), ("utf-8", "cp1252")),
]
# Honest text in other scripts and symbols, so that the clean class knows them.
HONEST = [
    "Âge moyen : 44 ans ; tâche réglée à 12 h, déjà visée par l'équipe.", "Où ça ? « Voilà », dit-il, près de l'église où l'été s'achève.", "Ключи от хранилища сданы, остаток на складе, журнал приёма.",
    "文档编号，由档案室保存五年，借阅须登记。请在周五之前提交报告，谢谢。", "保管期限 管理番號 擔當 部署 第三號 文書 年度", "Ρυθμίσεις για το αρχείο και τον κατάλογο.", "東京都の会議資料を確認してください。ありがとうございます。",
    "El año próximo, señor, la reunión será más corta; ¿verdad? ¡Sí!", "São Paulo, coração, informação e organização não são iguais.", "Příliš žluťoučký kůň úpěl ďábelské ódy. Zażółć gęślą jaźń.",
    "±2°C, 49 m², ×2, £776 ¥2631 ½ ¼ ¾ µm § ¶ © ® ™", "ÆRØ ÇELIK ÅNGSTRÖM ÑANDÚ ŒUVRE", "İstanbul, güneş, çağrı, öğrenci, şehir.", "Tiếng Việt: cộng hòa, độc lập, tự do, hạnh phúc.",
    "│ │ ││ │││ ┃ ┃┃ ║ ║║ ─── ━━━ ═══ ┌─┐ └─┘ ├─┤", "Fіrѕt cорy оf thе МК ВЕТА МАХ, оutdаted jоb frоm thе dеѕk; НОМЕ, СТОР, КРЕТ.",
    "Ｐrüfblatt ＭＫ-００００１９４, Ｓchlüssel ２８. Ａugust ２０２５, ＡＢＣ－１２３４５６７８９（ＩＴ）： ｆｕｌｌ ｗｉｄｔｈ",
]

_EVERYDAY = re.compile("[\t\n\r\x20-\x7e가-힣äöüÄÖÜß–—‘’“”„…·•※☎✉→■▶★◆▲●○□△◇☆~€]*")
_SANDWICH = re.compile("[A-Za-z][가-힣ㄱ-ㆎ一-鿿]+[a-z]")
_SPLIT = re.compile("(\n|(?<=[.!?…]) |['\"])")
_WORDS = re.compile("[ \t]+")


# Bytes of cp1252 without a character keep their number, as browsers do.
_FROM_1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TO_1252 = {**{b: 0xFFFF for b in _FROM_1252}, **{ord(c): b for b, c in _FROM_1252.items()}}


def _decode(data: bytes, codec: str, errors: str = "strict") -> str:
    return data.decode("latin-1").translate(_FROM_1252) if codec == "cp1252" else data.decode(codec, errors)


def _encode(text: str, codec: str) -> bytes:
    return text.translate(_TO_1252).encode("latin-1") if codec == "cp1252" else text.encode(codec)


def garble(text: str, chain: tuple) -> str | None:
    """``text`` after the mistakes of ``chain``; null if it cannot be written in its first encoding."""
    for written, read in chain:
        try:
            text = _decode(_encode(text, written), read, "replace")
        except UnicodeError:
            return None
    return text


def invert(text: str, chain: tuple) -> str | None:
    """The text before ``chain``, if every step back decodes strictly."""
    for written, read in reversed(chain):
        try:
            text = _decode(_encode(text, read), written)
        except UnicodeError:
            return None
    return text


def suspicious(segment: str) -> bool:
    """Holds unusual characters; marks alone, without a letter beyond ASCII, are layout and no text."""
    if _EVERYDAY.fullmatch(segment):
        return bool(_SANDWICH.search(segment))
    return "�" in segment or any(c.isalpha() and not c.isascii() or "\x80" <= c <= "\x9f" for c in segment)


def _garbled(segments: list[str], chain: tuple) -> list[str]:
    """What ``chain`` makes of segments (without line feeds) that it changes at all; decoded in one go."""
    now = segments
    for written, read in chain:
        data = []
        for x in now:
            try:
                data.append(_encode(x, written))
            except UnicodeError:
                continue
        now = _decode(b"\n".join(data), read, "replace").split("\n") if data else []
    same = set(segments)
    return [x for x in now if x not in same]


def _grams(data: bytes) -> np.ndarray:
    """Hashed byte bigrams with a byte beyond ASCII; line feeds part segments."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    a, b = raw[:-1], raw[1:]
    gram = (a * 256 + b)[((a > 127) | (b > 127)) & (a != 10) & (b != 10)]
    return (gram * 40503 >> 2) % FEATURES


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class ChainModel:
    """Multinomial naive Bayes over hashed byte bigrams; class 0 is clean text.

    ``honest`` are further segments of the clean class, counted ``weight`` times each.
    """

    def __init__(self, samples: list[str], honest: list[str] = HONEST, weight: int = 20) -> None:
        segments = list(dict.fromkeys(s for t in samples for s in _SPLIT.split(t) if s and not s.isascii() and len(s) > 2))
        clean = [s for s in segments if not suspicious(s)]
        odd = [s for s in segments if suspicious(s) and "�" not in s and all(invert(s, c) is None for c in CHAINS)]
        syllables = Counter(ch for s in clean for ch in set(s) if "가" <= ch <= "힣")
        self.common = frozenset(ch for ch, n in syllables.items() if n >= 2)
        counts = [np.bincount(_grams(_bytes("\n".join(clean + odd))), minlength=FEATURES) + weight * np.bincount(_grams(_bytes("\n".join(honest))), minlength=FEATURES)]
        counts += [np.bincount(_grams(_bytes("\n".join(_garbled(clean, chain)))), minlength=FEATURES) for chain in CHAINS]
        smooth = np.stack(counts) + 0.05
        self.table = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)

    @lru_cache(maxsize=1 << 14)  # noqa: B019
    def ranked(self, segment: str) -> list[int]:
        """Classes from the likeliest on, as far as they beat clean text by ``MARGIN``, then 0."""
        score = self.table[:, _grams(_bytes(segment))].sum(1)
        score[0] += MARGIN
        order = np.argsort(-score, kind="stable").tolist()
        return order[: order.index(0) + 1]

    def plausible(self, text: str, known: float = 0.75) -> bool:
        """Reads like clean text: syllables of which this share is known, letters, no controls or
        replacement marks. What decodes as UTF-8 hardly does so by chance and need not be known."""
        odd = [c for c in text if not c.isascii()]
        if not odd:
            return False
        hangul = [c for c in odd if "가" <= c <= "힣"]
        other = [c for c in odd if not "가" <= c <= "힣" and not _EVERYDAY.fullmatch(c)]
        good = sum(c in self.common for c in hangul)
        return good >= known * len(hangul) and len(other) * 4 <= len(odd) and not any("\x80" <= c <= "\x9f" or c == "�" for c in other)

    def examine(self, segment: str) -> tuple[bool, str | None, str]:
        """(garbled, restored text, chain) of one suspicious segment."""
        for k in self.ranked(segment):
            if k == 0:
                break
            if "�" in segment:
                return True, None, _name(k)
            chain = CHAINS[k - 1]
            back = invert(segment, chain)
            if back is not None and back != segment and self.plausible(back, 0.0 if chain[0][0] == "utf-8" else 0.75):
                return True, back, _name(k)
        return False, None, ""


def _name(k: int) -> str:
    return "" if not k else " ".join(f"{w}>{r}" for w, r in CHAINS[k - 1])


def repair(model: ChainModel, text: str) -> tuple[bool, str | None, str]:
    """(garbled in part at least, restored text or null, chains) of a whole record.

    Restored is null for clean records and for those of which a part cannot be regained.
    """
    if not suspicious(text):
        return False, None, ""
    out, garbled, lost, chains = [], False, False, []

    def look(piece: str) -> str | None:
        nonlocal garbled, lost
        hit, back, chain = model.examine(piece)
        if hit:
            garbled = True
            chains.append(chain)
            lost |= back is None
            return back or piece
        return None

    for segment in _SPLIT.split(text):
        if not segment or not suspicious(segment):
            out.append(segment or "")
            continue
        whole = look(segment)
        if whole is None:  # garbled words between clean ones
            words, at = [], 0
            for m in [*_WORDS.finditer(segment), None]:
                word = segment[at : m.start() if m else len(segment)]
                words.append((look(word) or word) if suspicious(word) and len(word) > 1 else word)
                if m:
                    words.append(m[0])
                    at = m.end()
            whole = "".join(words)
        out.append(whole)
    return garbled, "".join(out) if garbled and not lost else None, ",".join(sorted(set(chains)))


def _sample(texts: DataFrame, rows: int) -> list[str]:
    """Texts with the smallest hashes, about ``rows``: a fixed, bounded training sample.

    A share of the range of hashes is read that holds four times as many rows if they are all different, so that
    no more than these are ever shuffled; a text stored in a third of all rows counts once.
    """
    n = texts.count()
    h = F.xxhash64("text")
    got = texts.select("text").filter(F.length("text") > 2)
    if n > 4 * rows:
        got = got.filter(h <= F.lit(-(1 << 63) + (1 << 64) * 4 * rows // n))
    return [r.text for r in got.distinct().orderBy(h, "text").limit(rows).collect()]


def repaired(df: DataFrame, keys: list[str], text: str, train: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``keys`` and (garbled, restored, chains) of every row.

    ``train`` (default: ``df`` itself) gives the sample of at most ``train_rows`` texts in its column
    ``text``. Null and empty texts are not garbled; repeated rows come out repeated; ``restored`` is
    null where nothing was garbled or something is lost for good. Texts are read whole.
    """
    source = train if train is not None else df.select(F.col(text).alias("text"))
    samples = _sample(source, train_rows)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`_k{i}` {types[k]}" for i, k in enumerate(keys)) + ", garbled boolean, restored string, chains string"

    model = ChainModel(samples)  # a few MB, whatever the size of the data

    def make():  # noqa: ANN202
        def run(*columns):  # noqa: ANN002, ANN202
            done = [repair(model, t or "") for t in columns[-1]]
            return [*columns[:-1], *([d[k] for d in done] for k in range(3))]

        return run

    out = map_batches(df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(text).alias("_text")), make, schema)
    return out.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})


def garbled_records(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """(item_kind, item_id, text) of block texts and single warnings; rows that come twice come out twice."""
    b = blocks.select(F.lit("block").alias("item_kind"), F.col("block_id").cast("string").alias("item_id"), "text")
    w = parts.select(F.lit("warning").alias("item_kind"), F.col("part_id").cast("string").alias("item_id"), F.explode("warnings").alias("text"))
    return b.unionByName(w).filter("text is not null")


def found_garbled(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """(item_kind, item_id) of blocks and parts with a garbled text or warning, restorable or not."""
    records = garbled_records(blocks, parts)
    done = repaired(records, ["item_kind", "item_id"], "text", train=records)
    return done.filter("garbled").select("item_kind", "item_id").distinct()
