"""Word lists and rules for answers that are no proper answers; shared by problems 5 and 6."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that stand for nothing, as letters and digits in lower case.
PLACEHOLDERS = frozenset("empty null none nil nan na undefined blank todo tbd 空 暂无 无内容 空白 待补充 未填写 vacío leer".split())

#: Phrases that decline to answer.
REFUSALS = (
    r"我(?:们|目前|现在|暂时|也|并|还|实在|恐怕)*(?:不能|无法|没法|不便|不会|没有办法|没有权限|不方便|不可以)(?!直接|脱离)[^，。！？\n]{0,24}?(?:提供|回答|作答|讨论|谈论|处理|协助|帮助|给出答案|回应|解答)",
    r"(?:无法|不能|不便)(?:回答|解答|回应)(?:关于|这|该|您|此)",
    r"(?:请求|要求|问题)我?只能(?:婉拒|拒绝)", r"超出了?我的(?:能力|知识|职责)范围", r"请?恕我(?:跳过|不便|不能|无法|拒绝)", r"恕不(?:作答|回答)", r"帮不上[^，。！？\n]{0,24}忙", r"拒绝回答", r"我(?:必须|只能|需要)(?:拒绝|婉拒)",
    r"\b(?:can(?:'|’)?t|cannot|can not|won(?:'|’)t|will not|am not able to|(?:'|’)m not able to|am unable to|(?:'|’)m unable to|could not|do not have permission to) (?:help|answer|provide|assist|discuss|respond|comment|share|talk|comply|address)\b",
    r"\b(?:must|have to|need to) (?:decline|refuse)", r"\boutside (?:of )?what i can\b", r"\bbeyond (?:what i can|my (?:scope|abilit))", r"\bi (?:decline|refuse) to\b", r"\b(?:won(?:'|’)t|will not) be (?:answering|discussing|responding)\b", r"\bha(?:ve|d) to turn down\b", r"\bno (?:response|answer) [^.!?\n]{0,80}can be given\b", r"\bhave no way to (?:help|answer|provide|discuss|address)\b", r"\bnot something i can\b",
    r"\bno puedo (?:responder|ayudar|hablar|tratar|dar|contestar|ofrecer|comentar)", r"\bdebo (?:rechazar|declinar)", r"\bno me es posible\b", r"\bno estoy autorizad", r"\bqueda fuera de (?:mi|lo que)", r"\bprefiero no\b", r"\bno podr[ée] (?:responder|ayudar)",
    r"\bkann ich [^.!?\n]{0,60}(?:nichts sagen|nicht (?:beantworten|helfen|behandeln))", r"\bdarf ich [^.!?\n]{0,60}nicht beantworten", r"\bmuss ich [^.!?\n]{0,60}ablehnen", r"\bich kann [^.!?\n]{0,60}(?:nicht (?:beantworten|helfen|behandeln)|nichts sagen)", r"\bnicht in der lage\b", r"\bliegt außerhalb\b",
)
_REFUSAL = re.compile("|".join(REFUSALS), re.I)
#: What a text with one of these phrases must hold in lower case; spares most texts the expressions.
_DECLINES = (
    "不能", "无法", "没法", "不便", "不会", "没有办法", "没有权限", "不方便", "不可以", "只能", "超出", "恕", "帮不上", "拒",
    "can't", "can’t", "cannot", "can not", "won't", "won’t", "will not", "not able to", "unable to", "could not", "permission to", "decline", "refuse", "what i can", "beyond", "turn down", "can be given", "no way to", "not something i can",
    "no puedo", "debo ", "no me es posible", "no estoy autorizad", "queda fuera", "prefiero no", "no podr", "kann ich", "darf ich", "muss ich", "ich kann", "nicht in der lage", "liegt außerhalb",
)
#: The same for whole arrays, in the syntax of Arrow: first the phrases (and a lone dot above, which seed_refusal drops),
#: then the expressions without their conditions on what surrounds them. All that seed_refusal finds pass both.
_MAY_DECLINE = tuple(
    "|".join(x).replace("i", "[iıİ]").replace("ß", "[ßẞ]")
    for x in ([re.escape(x) for x in (*_DECLINES, "\u0307")], [re.sub(r"\\b|\(\?![^)]*\)", "", x) for x in REFUSALS])
)
#: Texts from which the refusal model is fitted are refusals only up to this length (CJK texts; others), since what follows may answer.
REFUSAL_CJK, REFUSAL_OTHER = 110, 300
_SENTENCE = re.compile(r"[^。！？.!?\n]+[。！？.!?]*\s*")
#: The label of an option, before a term that answers by naming it.
_OPTION = re.compile(r"^\s*[(（]?[A-Ha-h][.、)）:：]\s*(?=\S)")
_SPOKEN = re.compile(r"[，。！？；,;!?…：:]|\.\s|\.$")


#: How a repeated question may be marked.
COPY_MARK = re.compile(r"[（(]\s*(?:以上为题目|以上是题目|原题|题目如上|end of (?:the )?question|fin de la pregunta|ende der frage)\s*[）)]\s*$", re.I)


_NO_LETTERS = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    return _NO_LETTERS.sub("", text.lower())


def is_empty(text: str | None) -> bool:
    """Null, blank, or only a placeholder."""
    if text is None or not any(c.isalnum() for c in text):
        return True
    # a placeholder may stand in any amount of white space and marks, but the letters are few; mostly the first ones are too many already
    return sum(map(len, text[:200].split())) < 80 and sum(map(len, text.split())) < 80 and letters(text) in PLACEHOLDERS


def seed_refusal(text: str) -> bool:
    """A phrase that declines, early in a text too short to answer anyway: labels the rows that the refusal model is fitted on."""
    if len(text) > REFUSAL_OTHER:
        return False
    low = text.lower().replace("ſ", "s").replace("ı", "i").replace("\u0307", "")  # letters that an expression without case takes for s and i
    if not any(x in low for x in _DECLINES):
        return False
    m = _REFUSAL.search(text)
    if not m:
        return False
    cjk = sum("㐀" <= c <= "鿿" for c in text)
    limit = REFUSAL_CJK if cjk * 3 > len(text) else REFUSAL_OTHER
    return len(text) <= limit and len(_SENTENCE.findall(text[: m.start()])) <= 2


def seed_refusals(texts: pa.Array) -> np.ndarray:
    """seed_refusal of every text, null ones being none; only short texts that may decline are looked at one by one."""
    out = np.zeros(len(texts), bool)
    may = np.flatnonzero(pc.fill_null(pc.less_equal(pc.utf8_length(texts), REFUSAL_OTHER), False).to_numpy(zero_copy_only=False))
    for wide in _MAY_DECLINE:
        may = may[pc.match_substring_regex(texts.take(pa.array(may)), wide, ignore_case=True).to_numpy(zero_copy_only=False)]
    out[may] = [seed_refusal(t) for t in texts.take(pa.array(may)).to_pylist()]
    return out


def short_answer(text: str) -> bool:
    """A number, formula, letter or term: one line without sentence marks."""
    text = _OPTION.sub("", text, count=1)
    if "\n" in text or len(text) > 60 or _SPOKEN.search(text.strip(" .。")):
        return False
    cjk = sum("㐀" <= c <= "鿿" for c in text)
    return cjk <= 12 if cjk else len(text.split()) <= 3 or not re.search(r"[^\W\d_]{4,}", re.sub(r"\\\w+", "", text))


def _long_copy(answer: str, question: str) -> bool:
    """Whether an answer much longer than the question could still be a copy: only if most of it is no letter."""
    most = 1.3 * len(question) + 12
    return len(_NO_LETTERS.sub("", answer[: 2 * int(most)])) <= most and len(_NO_LETTERS.sub("", answer)) <= most


@functools.lru_cache(1024)
def _asked(question: str) -> tuple[str, frozenset[str]]:
    """The letters of a question and their 4-letter pieces; the same question often stands in many rows."""
    q = letters(question)
    return q, frozenset(q[i : i + 4] for i in range(len(q) - 3))


def copies_question(answer: str, question: str | None) -> bool:
    """Hardly more than the question again: most of the answer's 4-letter pieces are the question's, and most of the question is there."""
    if not question or len(answer) > 3 * len(question) + 60 and not _long_copy(answer, question):
        return False
    a, (q, gq) = letters(answer), _asked(question)
    if not q or not a or len(a) > 1.3 * len(q) + 12 or len(a) < 0.5 * len(q):
        return False
    if a == q:
        return True
    ga = {a[i : i + 4] for i in range(len(a) - 3)}
    both = len(ga & gq)
    return both >= 0.75 * len(ga) and both >= 0.5 * len(gq)
