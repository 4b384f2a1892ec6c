"""Problem 9: personal information inside free text, by a skip-chain conditional random field.

Candidate places come from wide patterns (anything that could be an e-mail address, a number of
seven or more digits, a document number, a street address or a name). Each candidate of a document
is a node of a conditional random field with the labels LABELS. Node potentials score the
candidate's shape, its pattern and the words around it; chain edges join neighbouring candidates;
skip edges join repeated or similar candidates wherever they stand in the document, so that a name
introduced once with a label is recognised again without one. Weights are fitted by
pseudo-likelihood on a bounded sample whose candidates are labelled by telling context
(SEEDS); labels are then inferred by loopy message passing over the whole document.

Null and empty texts hold nothing. The same text found several times counts once a document and
kind. Overlapping candidates are settled before labelling: addresses and e-mails beat numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.repetition import bounded_sample

LABELS = ("none", "email", "phone", "id_number", "address", "person")
#: Documents of the fitting sample; hash buckets of features; passes; message rounds; letters of context on each side.
SAMPLE_ROWS, FEATURES, EPOCHS, ROUNDS, CONTEXT = 6000, 1 << 15, 12, 6, 26

_H = "一-鿿"
#: Family names in Chinese (two-character ones first) that a name may begin with. Names that begin with a
#: character of everyday words (关 单 包 成 and the like) are candidates only behind a label.
FAMILY_NAMES = (
    "欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 令狐 慕容 闻人 夏侯 轩辕 长孙 宇文 司徒 独孤 南宫 "
    "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗 梁 宋 郑 谢 韩 唐 冯 于 董 萧 程 曹 袁 邓 许 傅 沈 曾 彭 吕 苏 卢 蒋 蔡 贾 丁 魏 薛 叶 阎 余 潘 杜 戴 夏 钟 汪 田 任 姜 范 方 石 姚 谭 廖 邹 熊 金 陆 郝 孔 白 崔 康 毛 邱 秦 江 史 顾 侯 邵 孟 龙 万 段 雷 钱 汤 尹 黎 易 常 武 乔 贺 赖 龚 文 "
    "柏 柳 岳 郁 褚 靳 邬 芮 储 裘 缪 羿 邴 汲 慕 宓 蔺 糜 璩 逄 邰 麴 訾 "
    "洪 施 严 樊 牛 温 季 俞 章 鲁 葛 韦 毕 聂 陶 欧 焦 柴 庞 颜 庄 辛 祝 左 涂 谷 祁 舒 耿 牟 卜 路 詹 苗 凌 费 纪 童 曲 阳 裴 席 卫 屈 鲍 覃 霍 翁 甘 景 宁 闵 辜 吉 饶 刁 瞿 戚 丘 滕 晋 苑 邢 臧 畅 苟 艾 娄 桂 晏 隋 卓 蒲 冉 荆 敖"
).split()

_AT = r"(?:@|＠|\s?\[at\]\s?|\s?\(at\)\s?|\s?（at）\s?)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._+\-])[A-Za-z0-9][A-Za-z0-9._+\-]*{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+", re.I)
NUMBER = re.compile(r"(?<![A-Za-z0-9_.,+])(?:\+?\(?\d[\d ()./\-]{5,24}[\dXx]|[A-Z]{1,2}\d{6,9})(?![A-Za-z0-9_])")
ADDRESS_ZH = re.compile(rf"(?<=[到在住至往于是址：: ，。、\n])(?:[{_H}]{{2,4}}?省)?[{_H}]{{2,4}}?市(?:[{_H}]{{1,4}}?[区县镇])?[{_H}]{{1,8}}?(?:路|街|大道|巷|弄|胡同)\d+号(?:[{_H}]{{1,6}}?(?:小区|花园|公寓|大厦))?(?:\d+(?:栋|幢|座))?(?:\d+单元)?(?:\d+楼)?(?:\d+室)?")
_STREET = "Street|Road|Lane|Avenue|Drive|Court|Way|Close|Row|Square|Terrace|Boulevard|Place|Crescent|Hill|Gardens|Park|Grove|Mews|Walk"
ADDRESS_EN = re.compile(rf"(?:(?:Flat|Apt|Unit|Suite) \w+, )?\b\d{{1,5}}[A-Z]? (?:[A-Z][a-z]+ ){{1,3}}(?:{_STREET})\b(?:, (?:Apt|Flat|Unit|Suite) \w+)?(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)?)?(?:,? [A-Z]{{2}})?(?: \d{{5}}(?:-\d{{4}})?)?")
ADDRESS_ES = re.compile(r"\b(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Carrera|Travesía|Rambla)(?: (?:de|del|la|las|los|el))* [A-ZÁÉÍÓÚÑ][\wáéíóúñ]+(?: [A-ZÁÉÍÓÚÑ][\wáéíóúñ]+)?,? \d{1,5}(?:, (?:\d+\.?[ºª°] ?\w*|bajo ?\w*|ático ?\w*))?(?:, \d{5})?(?:,? [A-ZÁÉÍÓÚÑ][\wáéíóúñ]+)?")
ADDRESS_DE = re.compile(r"\b(?:(?:Am|An der|Im|Zum|Zur|Auf der|In der|Unter den) )?[A-ZÄÖÜ][\wäöüß]+(?:-[A-ZÄÖÜ][\wäöüß]+)* \d{1,4}[a-z]?, \d{5} [A-ZÄÖÜ][\wäöüß]+")
#: Capitalised words that start sentences and are no part of a name.
NO_NAME = "Korrigiert|Geschrieben|Verfasst|Geprüft|Corregido|Escrito|Revisado|Written|Checked|Yesterday|Today|Tomorrow|Gestern|Heute|Morgen|Ayer|Hoy|Mañana|The|This|That|When|Then|Later|Dear|Hello|From|Contact|Graded|Call|Text|Write|Send|Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Señor|Señora"
_U, _L = "A-ZÀ-ÖØ-ÞĀ-Ž", "a-zß-öø-ÿā-ž"
#: A part of a name: plain, hyphenated, with an apostrophe (O'Brien) or an inner capital (McDonald); particles between parts.
_PART = rf"[{_U}](?:['’][{_U}])?[{_L}]+(?:[{_U}][{_L}]+)?(?:-[{_U}][{_L}]+)*"
_PARTICLE = r"(?:(?:de|del|la|las|los|van|von|der|den|di|da|dos|y|zu|ten) )*"
NAME = re.compile(rf"(?<![\w\-'.])(?!(?:{NO_NAME})\b)(?:(?:{_PART}|[{_U}]\.)(?: [{_U}]\.)? {_PARTICLE}{_PART}(?:(?: {_PARTICLE}){_PART})?|{_PART}, {_PART})(?![\w\-'])")
_FAMILY = rf"(?:{'|'.join(n for n in FAMILY_NAMES if len(n) > 1)}|[{''.join(n for n in FAMILY_NAMES if len(n) == 1)}])"
NAME_ZH = re.compile(rf"(?:(?<=[由天是找请给与和向：: ，。、！？；\n(（])|^){_FAMILY}[{_H}]{{1,2}}(?=同学|老师|先生|女士|教授|博士|助教|学长|学姐|在群|在此|说|问|[，。、；！？）)\s]|$)", re.M)
#: Labels of a person in Chinese, behind which any two to four characters may be a name.
_LABEL_ZH = "联系人|批改人|负责人|收件人|姓名|作者"
NAME_LABELLED = re.compile(rf"(?:{_LABEL_ZH})[：: ]+([{_H}]{{2,4}})(?![{_H}])")
#: Documents of the sample in which a text must stand without any label, and never with one, to count as a common word.
COMMON_WORD = 3
_GATE = re.compile(r"\d{5}|[@＠]|[\[(（]at[\])）]", re.I)

#: Context that labels a candidate on its own: (pattern kind, text before, text after, label).
SEEDS = tuple(
    (kind, re.compile(before + r"$", re.I) if before else None, re.compile(after, re.I) if after else None, label)
    for kind, before, after, label in (
        ("number", r"(?:身份证号?码?|证件号?码?|登记信息|护照号?码?|社保号?码?|证件（|ssn|social security(?: number| no\.?)?|passport(?: or id| no\.?| number)?|id number[\w ]*?|identity no\.?|ausweisnummer|reisepass\w*|pasaporte|dni)[:：是为 （(]*(?:was |is )?\s*", "", "id_number"),
        ("number", r"(?:电话|手机|号码|热线|座机|同号|拨打|致电|来电|传真|phone|mobile|call|text|fax|tel\w*|number is|reach \w+ at|rückruf unter|anruf\w*|tel[eé]fono|llam\w+(?: al)?)[:：是为 ]*\s*", "", "phone"),
        ("number", r"(?:订单|编号|书号|版本|学号段?为?|单号|批次|流水|isbn[\w ]*?|order(?: ref| no\.?)?|ref\.?|release|version|bestellnummer|pedido|ticket|about|约为|ergebnis ist|resultado es|see table|附表|came out on|于|vom|reads)[:：是为 ]*\s*", "", "none"),
        ("name", r"(?:contact person|ansprechperson|persona de contacto|graded by|korrigiert von|corregido por|written by|classmate|dr\.|mr\.|mrs\.|ms\.|prof\.|herr|frau|señora?|sra?\.)[: ]*\s*", "", "person"),
        ("name", r"(?:yesterday|gestern|ayer) ", r"^ (?:asked|said|wrote|hat|fragte|pregunt)", "person"),
        ("name_zh", r"(?:联系人|批改人|负责人|收件人|姓名|作者)[：: ]*", "", "person"),
        ("name_zh", "", r"^(?:同学|老师|先生|女士|教授|博士|助教|学长|学姐|在群)", "person"),
    )
)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind of pattern) of every candidate, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []

    def add(pattern: re.Pattern, kind: str) -> None:
        for m in pattern.finditer(text):
            a, b = m.span()
            if all(b <= x or a >= y for x, y, _ in found):
                found.append((a, b, kind))

    if _GATE.search(text) or "号" in text:
        add(EMAIL, "email")
        if "号" in text:
            add(ADDRESS_ZH, "address")
    add(ADDRESS_EN, "address")
    add(ADDRESS_ES, "address")
    add(ADDRESS_DE, "address")
    for m in NUMBER.finditer(text):
        a, b = m.span()
        t = text[a:b]
        if t.count("(") > t.count(")"):
            a, t = (a + 1, t[1:]) if t[0] == "(" else (a, t)
        digits = sum(c.isdigit() for c in t)
        if digits < 6 or (digits < 7 and not t[0].isalpha()) or re.fullmatch(r"\d+\.\d+", t) or digits > 20:
            continue
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, "number"))
    add(NAME, "name")
    for m in NAME_LABELLED.finditer(text):
        a, b = m.span(1)
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, "name_zh"))
    add(NAME_ZH, "name_zh")
    return sorted(found)


def shape(text: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "0", text)))


def _dated(digits: str) -> bool:
    """Whether 18 characters hold a birth date where a national identity number has it."""
    return len(digits) == 18 and digits[6:8] in ("19", "20") and "01" <= digits[10:12] <= "12" and "01" <= digits[12:14] <= "31"


def features(text: str, a: int, b: int, kind: str) -> list[str]:
    """Names of the binary features of a candidate."""
    found, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    out = [kind]
    words = re.findall(rf"[^\W\d_{_H}]+|[{_H}]|[^\w\s]", before.lower().replace("\n", " ¶ "))[-4:]
    nexts = re.findall(rf"[^\W\d_{_H}]+|[{_H}]|[^\w\s]", after.lower())[:3]
    for n in (1, 2, 3):
        out.append(f"{kind}<{n}{'_'.join(words[-n:])}")
    out.append(f"{kind}>{'_'.join(nexts[:1])}")
    out.append(f"{kind}>>{'_'.join(nexts[:2])}")
    if kind == "number":
        compact = re.sub(r"[^\dXx]", "", found)
        out += [f"shape:{shape(found)}", f"digits:{len(compact)}", f"head:{found[:2]}", f"plus:{found[0] == '+'}", f"dated:{_dated(compact)}", f"iso:{bool(re.fullmatch(r'(?:19|20)\d\d-\d\d-\d\d', found))}", f"alpha:{found[0].isalpha()}", f"{len(compact)}:{_dated(compact)}"]
    elif kind.startswith("name"):
        parts = re.findall(rf"[^\W\d_{_H}]+|[{_H}]+", found)
        out += [f"part:{p}" for p in parts] + [f"nameshape:{shape(found)}", f"family:{found[:1]}" if kind == "name_zh" else f"last:{parts[-1]}"]
    else:
        out.append(f"{kind}:{bool(re.search(r'[0-9]', found))}")
    return out


def seed_label(text: str, a: int, b: int, kind: str) -> str | None:
    """The label that pattern or context gives for certain, or None."""
    if kind in ("email", "address"):
        return kind
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    if kind == "number" and re.fullmatch(r"(?:19|20)\d\d-\d\d-\d\d", text[a:b]):
        return "none"
    for k, left, right, label in SEEDS:
        if k == kind and (left is None or left.search(before)) and (right is None or right.search(after)):
            return label
    return "none" if kind == "name" else None


def similar(x: str, y: str) -> bool:
    """Candidates that a skip edge joins: equal ones, and names that share a longer part."""
    if x == y:
        return True
    a, b = set(re.findall(r"[^\W\d_]{4,}", x)), set(re.findall(r"[^\W\d_]{4,}", y))
    return bool(a & b)


class SkipChain:
    """weights[feature, label]; chain[label, label]; skip: gain of equal labels at both ends of a skip edge.

    All three are fitted together by pseudo-likelihood, given the labels of a candidate's neighbours along both kinds of edge.
    """

    def __init__(self, documents: list[str]):
        rng = np.random.default_rng(3)
        self.weights = np.zeros((FEATURES, len(LABELS)))
        self.chain, self.skip = np.zeros((len(LABELS), len(LABELS))), 1.0
        rows = []
        found = [candidates(t) for t in documents]
        seeds = [[seed_label(t, *c) for c in nodes] for t, nodes in zip(documents, found, strict=True)]
        common = self.common_words(documents, found, seeds)
        for t, nodes, labels in zip(documents, found, seeds, strict=True):
            labels = [y or ("none" if c[2] == "name_zh" and t[c[0] : c[1]] in common else None) for c, y in zip(nodes, labels, strict=True)]
            similar_to: dict[int, list[int]] = {}
            for i, j in self.skips(t, nodes):
                for x, y in ((i, j), (j, i)):
                    if labels[y] is not None:
                        similar_to.setdefault(x, []).append(LABELS.index(labels[y]))
            ids = [self.ids(features(t, *c)) for c in nodes]
            for i, y in enumerate(labels):
                if y is not None:
                    prev = LABELS.index(labels[i - 1]) if i and labels[i - 1] is not None else -1
                    rows.append((ids[i], LABELS.index(y), prev, similar_to.get(i, ())))
        for epoch in range(EPOCHS):
            rate = 0.3 / (1 + epoch)
            for j in rng.permutation(len(rows)):
                x, y, prev, near = rows[j]
                s = self.weights[x].sum(0) + (self.chain[prev] if prev >= 0 else 0)
                for z in near:
                    s[z] += self.skip
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y] -= 1
                self.weights[x] -= rate * p
                if prev >= 0:
                    self.chain[prev] -= 0.1 * rate * p
                for z in near:
                    self.skip -= 0.1 * rate * p[z]
        self.weights = self.weights.astype(np.float32)

    @staticmethod
    def common_words(documents: list[str], found: list[list[tuple[int, int, str]]], seeds: list[list[str | None]]) -> set[str]:
        """Texts of Chinese candidates that stand in several documents without a label and never with one: words, not names."""
        bare: dict[str, int] = {}
        named: set[str] = set()
        for t, nodes, labels in zip(documents, found, seeds, strict=True):
            mine = [(t[a:b], y) for (a, b, kind), y in zip(nodes, labels, strict=True) if kind == "name_zh"]
            named.update(x for x, y in mine if y)
            for x in {x for x, y in mine if not y}:
                bare[x] = bare.get(x, 0) + 1
        return {x for x, n in bare.items() if n >= COMMON_WORD and x not in named}

    @staticmethod
    def skips(text: str, nodes: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
        """Skip edges: each candidate is joined to the last similar one, so edges stay linear."""
        out: list[tuple[int, int]] = []
        groups: dict[str, int] = {}
        for i, (a, b, kind) in enumerate(nodes):
            keys = {text[a:b]} | (set(re.findall(r"[^\W\d_]{4,}", text[a:b])) if kind == "name" else set())
            out += [(j, i) for j in sorted({groups[k] for k in keys if k in groups}) if j < i - 1 or similar(text[nodes[j][0] : nodes[j][1]], text[a:b])]
            groups.update(dict.fromkeys(keys, i))
        return out

    @staticmethod
    def ids(names: list[str]) -> list[int]:
        return [zlib.crc32(n.encode()) % FEATURES for n in names]

    def allowed(self, kind: str) -> np.ndarray:
        """Log-potential that keeps a pattern to the labels it can have."""
        may = {"email": ("email",), "number": ("phone", "id_number"), "address": ("address",), "name": ("person",), "name_zh": ("person",)}[kind]
        return np.array([0.0 if y == "none" or y in may else -50.0 for y in LABELS])

    def label(self, text: str) -> list[tuple[str, str]]:
        """(kind, found) of every place that is personal information, in order."""
        return [(k, text[a:b]) for a, b, k in self.spans(text)]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of every place that is personal information, in order; each place has a label of its own."""
        nodes = candidates(text)
        if not nodes:
            return []
        node = np.stack([self.weights[self.ids(features(text, *c))].sum(0) + self.allowed(c[2]) for c in nodes])
        n = len(nodes)
        edges = [(i, i + 1, self.chain) for i in range(n - 1)]
        same = np.eye(len(LABELS)) * self.skip
        edges += [(j, i, same) for j, i in self.skips(text, nodes)]
        best = self._belief(node, edges).argmax(1)
        return [(a, b, LABELS[y]) for (a, b, _), y in zip(nodes, best, strict=True) if y]

    @staticmethod
    def _belief(node: np.ndarray, edges: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Loopy message passing in log space: rounds of all messages, then beliefs."""
        if not edges:
            return node
        ahead = [np.zeros(node.shape[1]) for _ in edges]
        back = [np.zeros(node.shape[1]) for _ in edges]
        belief = node.copy()

        def push(x: np.ndarray, table: np.ndarray) -> np.ndarray:
            s = x[:, None] + table
            top = s.max(0)
            out = top + np.log(np.exp(s - top).sum(0))
            return out - out.max()

        for _ in range(ROUNDS if len(edges) >= len(node) else max(ROUNDS, min(len(node), 12))):
            fresh = node.copy()
            new_ahead = [push(belief[i] - back[e], t) for e, (i, _, t) in enumerate(edges)]
            new_back = [push(belief[j] - ahead[e], t.T) for e, (_, j, t) in enumerate(edges)]
            ahead, back = new_ahead, new_back
            for e, (i, j, _) in enumerate(edges):
                fresh[j] += ahead[e]
                fresh[i] += back[e]
            belief = fresh
        return belief


def fit(df: DataFrame, key: str, text: str) -> Broadcast:
    """The field fitted on a bounded sample, sent to the executors; FEATURES weights for each label."""
    return df.sparkSession.sparkContext.broadcast(SkipChain(bounded_sample(df, key, text, SAMPLE_ROWS)))


def personal(df: DataFrame, key: str, text: str, model: Broadcast | None = None) -> DataFrame:
    """(key, kind, found) of every text, each found text once a kind."""
    sent = model or fit(df, key, text)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for b in batches:
            row, kinds, found = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, f in dict.fromkeys(field.label(t)) if t else ():
                    row.append(i)
                    kinds.append(k)
                    found.append(f)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(kinds, pa.string()), pa.array(found, pa.string())], [key, "kind", "found"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, kind string, found string")


def redacted(df: DataFrame, key: str, text: str, model: Broadcast | None = None) -> DataFrame:
    """(key, text, places) with every place replaced by its kind in brackets; null texts stay null."""
    sent = model or fit(df, key, text)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for b in batches:
            texts, places = [], []
            for t in b.column(1).to_pylist():
                spans = field.spans(t) if t else []
                for a, e, k in reversed(spans):
                    t = f"{t[:a]}[{k.upper()}]{t[e:]}"
                texts.append(t)
                places.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(places, pa.int32())], [key, text, "places"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{text}` string, places int")
