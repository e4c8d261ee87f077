"""Words of texts: lower-case ones, and those of a dictionary in runs of CJK characters, the most probable segmentation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of words and weights that may be sent to every task.
MOST_SENT = 64 << 20
#: Bytes of texts that are cut into words at a time.
SLICE = 4 << 20
#: Bytes of which words of letters and digits consist.
LATIN = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))

# Words of the bill trade and how often they are taken to occur.
BILL_WORDS = {
    **dict.fromkeys(("票据贴现", "转贴现", "买断式回购", "质押式回购", "银行承兑汇票", "商业承兑汇票"), 100),
    **dict.fromkeys(("票据托收", "票据质押", "背书转让", "贴现利率", "转贴现利率", "再贴现", "票据经纪"), 80),
    **dict.fromkeys(("持牌机构", "票据市场", "出票人", "承兑人", "背书人", "收款人", "持票人", "汇票", "本票", "支票", "到期日", "出票日期", "承兑日期", "票面金额"), 60),
    **dict.fromkeys(("票据池", "票据融资", "供应链金融", "应收账款", "保理业务", "票据中介", "票据监管", "票据法"), 60),
    "中国人民银行": 100,
    **dict.fromkeys(("银保监会", "票据交换所", "上海票交所"), 80),
    "电子商业汇票": 80,
    **dict.fromkeys(("纸质汇票", "票据真伪鉴别", "票据风险", "票据欺诈", "克隆票", "变造票", "空克隆票据", "无效票据", "瑕疵票据", "背书连续", "背书不连续"), 60),
    **dict.fromkeys(("空白背书", "限制性背书", "票据追索权", "拒付", "提示付款", "委托收款", "质押背书", "贴现申请", "贴现行", "付款行", "开票行", "代理行"), 60),
    **dict.fromkeys(("票据行权", "到期兑付", "提前兑付", "利率报价", "询价撮合", "逐笔结算", "全额结算", "净额结算", "实时全额结算", "大额支付系统"), 60),
    **dict.fromkeys(("票据回购", "票据置换", "票据组合", "票据资产", "票据收益率", "票据久期", "票据信用风险", "票据流动性风险", "票据操作风险"), 60),
    **dict.fromkeys(("内部评级", "外部评级", "穿透监管", "实质重于形式"), 60),
}


def weights(words: dict[str, int]) -> tuple[dict[str, int], int]:
    """Each word's logarithmic probability in millionths, and that of a single unknown character,
    which counts as seen once. Whole numbers, so that sums are equal wherever they are made."""
    total = sum(words.values()) or 1
    log = lambda n: int(round(1e6 * float(np.log(max(1, n) / total))))
    return {w: log(n) for w, n in words.items()}, log(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Dictionary:
    """The words by length, each length's sorted by a hash of their characters."""

    def __init__(self, words: dict[str, int]):
        known, self.single = weights({w: n for w, n in words.items() if w})
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({len(w) for w in known}):
            here = [w for w in known if len(w) == k]
            codes = points("".join(here)).reshape(len(here), k)
            keys = self.keys(codes.T)
            order = np.argsort(keys)
            self.of_length[k] = keys[order], codes[order], np.array([known[w] for w in here])[order]

    @staticmethod
    def keys(columns: np.ndarray | list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = mix(out ^ c.astype(np.uint64))
        return out

    def edges(self, codes: np.ndarray, left: np.ndarray) -> dict[int, np.ndarray]:
        """For each length of words the weight of the word that begins at each character, the lowest
        number where none does. ``left`` tells how many characters of its run begin there."""
        none, out = np.iinfo(np.int64).min // 2, {}
        for k, (keys, words, weight) in self.of_length.items():
            at = np.flatnonzero(left >= k)
            found = np.full(len(codes), none)
            if len(at):
                place = np.minimum(np.searchsorted(keys, self.keys([codes[at + i] for i in range(k)])), len(keys) - 1)
                same = np.all([codes[at + i] == words[place, i] for i in range(k)], axis=0)
                found[at[same]] = weight[place[same]]
            out[k] = found
        return out

    def sizes(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The length of the word that begins at each character on the best way to its run's end.

        Runs lie one after another; ``ends`` says where. All runs take a step together, from their
        last characters on. Of ways with equal weights the one with the longer first word is taken.
        """
        begins = np.append(0, ends[:-1])
        left = np.repeat(ends, ends - begins) - np.arange(len(codes))
        edges = self.edges(codes, left)
        best, size = np.zeros(len(codes) + 1, np.int64), np.ones(len(codes), np.int64)
        order = np.argsort(left, kind="stable")
        steps = np.searchsorted(left[order], np.arange(1, left.max(initial=0) + 2))
        for a, b in zip(steps, steps[1:], strict=False):
            at = order[a:b]
            after = np.where(left[at] > 1, best[np.minimum(at + 1, len(codes))], 0)
            top, chosen = np.full(len(at), self.single) + after, np.ones(len(at), np.int64)
            for k, weight in edges.items():
                rest = np.where(left[at] > k, best[np.minimum(at + k, len(codes))], 0)
                way = weight[at] + rest
                # A single character that is in the dictionary has its own weight.
                better = (way >= top) if k > 1 else (weight[at] > np.iinfo(np.int64).min // 2)
                top, chosen = np.where(better, way, top), np.where(better, k, chosen)
            best[at], size[at] = top, chosen
        return size

    def cut(self, runs: list[str]) -> list[list[str]]:
        """The words of each run."""
        ends = np.cumsum([0, *map(len, runs)])[1:]
        if not len(ends) or not ends[-1]:
            return [[] for _ in runs]
        keep = [i for i, r in enumerate(runs) if r]
        size, out = self.sizes(points("".join(runs)), ends[keep]).tolist(), []
        for run, end in zip(runs, ends.tolist(), strict=True):
            start, words = end - len(run), []
            at = start
            while at < end:
                words.append(run[at - start : at - start + size[at]])
                at += size[at]
            out.append(words)
        return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def from_table(words: DataFrame) -> dict[str, int]:
    """A word list (word, frequency) as a dictionary, after a check of its bytes: null words and
    frequencies are left out, and of a repeated word the highest counts."""
    known = words.where("word is not null and frequency is not null").groupBy("word").agg(F.max("frequency").alias("frequency"))
    size = known.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    if size > MOST_SENT:
        raise ValueError(f"a word list of {size} bytes is too large to be sent to every task")
    return {r["word"]: int(r["frequency"]) for r in known.collect()}


def _pieces(raw: np.ndarray, offsets: np.ndarray, joined: bool) -> pa.Array:
    """Lists of the words of letters and digits and of the CJK characters, or with ``joined`` their
    runs, in UTF-8 texts that lie one after another."""
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    keep = LATIN[raw]
    begin = keep.copy()
    begin[1:] &= first[1:-1] | ~keep[:-1]
    lead = np.flatnonzero((raw >= 0xE4) & (raw <= 0xE9))
    if len(lead):
        lead = lead[lead + 2 < len(raw)]
        code = (raw[lead].astype(np.int32) & 15) << 12 | (raw[lead + 1].astype(np.int32) & 63) << 6 | raw[lead + 2] & 63
        lead = lead[(code >= 0x4E00) & (code <= 0x9FFF)]
        begin[lead] = first[lead] | (np.diff(lead, prepend=-3) != 3) if joined else True
        for i in range(3):
            keep[lead + i] = True
    starts = np.flatnonzero(begin)
    places = np.cumsum(keep, dtype=np.int32)[starts] - 1
    data = raw[keep]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(places, len(data)).astype(np.int32)), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets).astype(np.int32)), words)


def pieces(texts: pa.Array, joined: bool = False) -> pa.Array:
    """Per lower-case text its words of a-z and 0-9 and its CJK characters one by one, or ``joined`` as
    runs, in order; null for a null text. Texts are cut over their bytes, some at a time."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return pa.array([[] if x else None for x in texts.is_valid().to_pylist()], pa.list_(pa.string()))
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw, out, a = np.frombuffer(data, np.uint8), [], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        out.append(_pieces(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], joined))
        a = b
    lists = pa.concat_arrays(out)
    return pa.ListArray.from_arrays(lists.offsets, lists.values, mask=texts.is_null())


class Words:
    """A way to take words out of texts: ``cut`` makes lists of words of an Arrow array of lower-case
    texts within a task; called with a column it gives the column of its words."""

    def __init__(self, cut: Callable[[pa.Array], pa.Array]):
        self.cut = cut

    def __call__(self, text: Column) -> Column:
        cut = self.cut

        @F.arrow_udf("array<string>")
        def run(texts: pa.Array) -> pa.Array:
            return cut(texts)

        return run(F.lower(text))


def dictionary_words(words: dict[str, int]) -> Words:
    """Lower-case words of letters and digits, and the most probable words of CJK runs, in order.

    Characters that no word of the dictionary fits stand alone. Null texts have null tokens.
    """
    made: list[Dictionary] = []

    def cut(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Dictionary(words))
        lists = pieces(texts, joined=True)
        # Each distinct run is cut once in a batch; texts repeat most of theirs.
        flat = lists.flatten().dictionary_encode()
        found = flat.dictionary.to_pylist()
        runs = [i for i, x in enumerate(found) if not x.isascii()]
        size = np.ones(len(found), np.int64)
        for i, words_of in zip(runs, made[0].cut([found[i] for i in runs]), strict=True):
            found[i], size[i] = words_of, len(words_of)
        words_out = pa.array([w for x in found for w in (x if isinstance(x, list) else (x,))], pa.string())
        begin, piece = np.append(0, np.cumsum(size)[:-1]), flat.indices.to_numpy()
        sizes = size[piece]
        whole = np.arange(sizes.sum()) + np.repeat(begin[piece] - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        places = np.append(0, np.cumsum(sizes))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), words_out.take(pa.array(whole)), mask=lists.is_null())

    return Words(cut)


def dictionary_tokens(text: Column, words: dict[str, int]) -> Column:
    return dictionary_words(words)(text)
