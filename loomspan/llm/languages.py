"""Missing or wrong document language labels (problem 9).

Each document is a mixture of languages. Its whole sentences get likelihoods from letter n-grams of
every language; expectation-maximisation finds the proportions, and a language stays in the mixture
only while its likelihood gain exceeds a penalty. The n-gram model is trained from the table's own
labels, with wrong labels outvoted and then relabelled by the model itself.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "zh", "ja")
SAMPLE = 200  # labelled documents per language that the model is trained on, on average at most
PENALTY = 4.0  # gain of log likelihood below which a language leaves a document's mixture
TEMPER = 0.5  # n-grams overlap; their log likelihoods count so much
WHOLE = 2  # whole sentences that make a language a document's own

# Codes and English names of the languages.
NAMES = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish castilian",
    "pt": "pt por portuguese", "it": "it ita italian", "nl": "nl nld dut dutch flemish", "ru": "ru rus russian",
    "zh": "zh zho chi cmn chinese mandarin", "ja": "ja jpn japanese",
}
_BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}
# A few sentences of each language, for tables with too few labels.
SEED = {
    "en": "The report was written before the meeting, and everyone who had read it agreed with its main point. There is nothing here that you would not find in the other book. They have been waiting for an answer since last week.",
    "de": "Der Bericht wurde vor der Sitzung geschrieben, und alle, die ihn gelesen hatten, stimmten dem wichtigsten Punkt zu. Hier steht nichts, was man nicht auch im anderen Buch finden würde. Sie warten seit der letzten Woche auf eine Antwort.",
    "fr": "Le rapport a été écrit avant la réunion, et tous ceux qui l'avaient lu étaient d'accord avec son idée principale. Il n'y a rien ici que vous ne trouveriez pas dans l'autre livre. Ils attendent une réponse depuis la semaine dernière.",
    "es": "El informe se escribió antes de la reunión, y todos los que lo habían leído estaban de acuerdo con su idea principal. Aquí no hay nada que no se encuentre también en el otro libro. Esperan una respuesta desde la semana pasada.",
    "pt": "O relatório foi escrito antes da reunião, e todos os que o tinham lido concordaram com a ideia principal. Aqui não há nada que não se encontre também no outro livro. Eles esperam uma resposta desde a semana passada.",
    "it": "Il rapporto è stato scritto prima della riunione, e tutti quelli che lo avevano letto erano d'accordo con il punto principale. Qui non c'è nulla che non si trovi anche nell'altro libro. Aspettano una risposta dalla settimana scorsa.",
    "nl": "Het verslag werd voor de vergadering geschreven, en iedereen die het gelezen had was het eens met het belangrijkste punt. Hier staat niets dat je niet ook in het andere boek zou vinden. Zij wachten sinds vorige week op een antwoord.",
    "ru": "Доклад был написан до собрания, и все, кто его прочитал, согласились с главной мыслью. Здесь нет ничего, чего нельзя было бы найти в другой книге. Они ждут ответа с прошлой недели.",
    "zh": "报告是在会议之前写好的，所有读过它的人都同意其中的主要观点。这里没有什么是在另一本书里找不到的。他们从上个星期起就一直在等待答复。",
    "ja": "報告書は会議の前に書かれ、それを読んだ人は皆、主な点に同意しました。ここには、ほかの本で見つからないものは何もありません。彼らは先週から返事を待っています。",
}

_LINE = re.compile(r"\r\n|\r|\n|\u2028|\u2029")
_FENCE = re.compile(r"\s*(```|~~~)")
_HEADING = re.compile(r"\s{0,3}#{1,6}(\s|$)")
_RULE = re.compile(r"[\s=\-_*~#|:+.]*$")
_LOG = re.compile(r"\s*[\[(]?(\d{4}-\d\d-\d\d[T ]\d|\d\d:\d\d:\d\d|(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b[ :\]])")
_MARK = re.compile(r"\s*((?:[*+\-•>|]|\d{1,3}[.)]|//|--)\s+)+")
_NAME = r"(?:[A-Za-z0-9_]|\.(?=[A-Za-z0-9_]))*"  # the rest of an identifier: a full stop after it isn't of it
_CODE = re.compile(
    r"`+[^`\n]*`+|https?://[!-~]+|<[^<>\n]{1,80}>"
    rf"|(?<![A-Za-z0-9_.])[A-Za-z0-9]*(?:_{_NAME}|(?<=[A-Za-z0-9])\.(?=[A-Za-z0-9_]){_NAME}|(?<=[a-z])(?=[A-Z]){_NAME}|(?=\(\))|(?==)[!-~]*)(?:\(\))?"
)
_QUOTED = re.compile(r"\(?[«“„「『\"](?:[^«»“”„「」『』\"\n.!?。！？]{1,60})[»”“」』\"]\)?")
_STOP = re.compile(r"(?<=[.!?…])[\"'»”)\]*_]*\s+(?![a-zà-öø-ÿа-я])|(?<=[。！？])[」』”）]?\s*")
_WHOLE = re.compile(r"[.!?…。！？][\"'»”)\]」』*_]*\s*$")
_RUN = re.compile(r"[^\W\d_]+")
_THREE_RUNS = re.compile(r"[^\W\d_](?:[^\W\d_]*[\W\d_]+[^\W\d_]){2}")
# What every match of _CODE and of _QUOTED holds; texts without it needn't be searched by them.
_MAYBE_CODE, _MAYBE_QUOTED = re.compile(r"[`<_=]|://|\(\)|[A-Za-z0-9]\.[A-Za-z0-9_]|[a-z][A-Z]"), re.compile(r"[«“„「『\"]")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def named_language(label: str | None) -> str | None:
    """The language that a label names: codes of two or three letters, with regions behind them, or English
    names with other words around them, in any case. Null for a label that names none of LANGUAGES, nothing,
    or several by name."""
    words = re.findall("[a-z]+", (label or "").lower())
    if words and words[0] in _BY_NAME:
        return _BY_NAME[words[0]]
    named = {_BY_NAME[w] for w in words[1:] if len(w) > 3 and w in _BY_NAME}  # a short word elsewhere may be a region or any word
    return named.pop() if len(named) == 1 else None


def label_language(label: Column) -> Column:
    """named_language() as a column."""
    words = F.regexp_extract_all(F.lower(label), F.lit("[a-z]+"), F.lit(0))
    codes = F.create_map(*(F.lit(x) for pair in sorted(_BY_NAME.items()) for x in pair))
    full = F.create_map(*(F.lit(x) for pair in sorted(_BY_NAME.items()) if len(pair[0]) > 3 for x in pair))
    later = F.array_distinct(F.filter(F.transform(F.slice(words, 2, 1 << 30), lambda w: F.try_element_at(full, w)), lambda c: c.isNotNull()))
    return F.coalesce(F.try_element_at(codes, F.get(words, F.lit(0))), F.when(F.size(later) == 1, F.get(later, F.lit(0))))


def whole_sentences(text: str) -> list[str]:
    """The whole sentences of a text, in order, without headings, code, log lines and short quotations.
    Broken lines are joined; list entries and table rows stand for themselves."""
    out, paragraph, fenced = [], [], False

    def flush() -> None:
        if paragraph:
            joined = " ".join(paragraph)
            if _MAYBE_CODE.search(joined):
                joined = _CODE.sub(" § ", joined)
            if _MAYBE_QUOTED.search(joined):
                joined = _QUOTED.sub(" ", joined)
            for s in _STOP.split(joined):
                if _WHOLE.search(s) and (_THREE_RUNS.search(s) or len(_CJK.findall(s)) >= 5):
                    out.append(s.strip())
            paragraph.clear()

    for line in _LINE.split(text):
        if _FENCE.match(line):
            flush()
            fenced = not fenced
        elif fenced:
            continue
        elif not line.strip() or _HEADING.match(line) or _RULE.match(line) or _LOG.match(line):
            flush()
        else:
            mark = _MARK.match(line)
            if mark and mark.group().strip()[0] not in ">/|-" or mark and mark.group().strip() == "-":
                flush()
            paragraph.append(line[mark.end() :] if mark else line.strip())
            if _WHOLE.search(line):
                flush()
    flush()
    return out


def _grams(run: str) -> list[str]:
    """Letter n-grams of a run of letters: up to three with its edges, or one and two of CJK letters."""
    if _CJK.search(run):
        return [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
    edged = f"^{run}$"
    return [edged[i : i + 3] for i in range(len(edged) - 2)] + [edged]


class Model:
    """Log likelihoods of letter n-grams by language."""

    def __init__(self, counts: dict[str, Counter]):
        vocabulary = sorted({g for c in counts.values() for g in c})
        self.row = {g: n for n, g in enumerate(vocabulary)}
        table = np.array([[counts[code].get(g, 0) for code in LANGUAGES] for g in vocabulary], np.float64).reshape(-1, len(LANGUAGES))
        smooth = 0.1
        total = table.sum(0) + smooth * (len(vocabulary) + 1)
        self.table = np.vstack([np.log((table + smooth) / total), np.log(smooth / total)[None]]).astype(np.float32)
        self.forget()

    def forget(self) -> None:
        """Empties the store of runs of letters that were scored."""
        self._at: dict[str, int] = {}
        self._known = np.empty((4096, len(LANGUAGES)), np.float32)

    def _place(self, run: str) -> int:
        """Where a run's log likelihoods lie in the store."""
        at = self._at.get(run)
        if at is None:
            at = self._at[run] = len(self._at)
            if at == len(self._known):
                self._known = np.concatenate([self._known, np.empty_like(self._known)])
            self._known[at] = self.table[[self.row.get(g, -1) for g in _grams(run)]].sum(0)
        return at

    def scores(self, sentences: list[str]) -> np.ndarray:
        """Tempered log likelihoods, a row per sentence; 0 for one without letters."""
        if len(self._at) > 200_000:
            self.forget()
        runs = [_RUN.findall(s.lower()) for s in sentences]
        sizes = np.array([len(r) for r in runs])
        places = np.fromiter((self._place(r) for some in runs for r in some), np.int64, int(sizes.sum()))
        out = np.zeros((len(sentences), len(LANGUAGES)))
        if len(places):
            full = np.flatnonzero(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            out[full] = np.add.reduceat(self._known[places].astype(np.float64), starts, axis=0)
        return TEMPER * out


def train(labelled: list[tuple[str, str]], rounds: int = 2) -> Model:
    """Model from (text, language), whose languages may be wrong for some: each round relabels the
    sentences by the model so far."""
    sentences, labels = [], []
    for code, text in SEED.items():
        for s in whole_sentences(text):
            sentences.append(s)
            labels.append(code)
    n_seed = len(sentences)
    for text, code in labelled:
        for s in whole_sentences(text or ""):
            sentences.append(s)
            labels.append(code)
    grams = [Counter(g for r in _RUN.findall(s.lower()) for g in _grams(r)) for s in sentences]
    for step in range(rounds + 1):
        counts: dict[str, Counter] = defaultdict(Counter)
        for code, g in zip(labels, grams, strict=True):
            counts[code].update(g)
        model = Model({code: counts[code] for code in LANGUAGES})
        if step < rounds:
            best = model.scores(sentences).argmax(1)
            labels[n_seed:] = [LANGUAGES[k] for k in best[n_seed:]]
    return model


def _by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by document; doc ascends."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.zeros((n, *values.shape[1:]))
    if len(starts):
        out[doc[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _fit(scores: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document, by expectation-maximisation over allowed."""
    size = np.bincount(doc, minlength=n)[:, None].clip(1)
    share = allowed / allowed.sum(1, keepdims=True).clip(1)
    top = scores.max(1, keepdims=True)
    likely = np.exp(np.maximum(scores - top, -700))
    for _ in range(rounds):
        weight = likely * share[doc]
        share = _by_doc(weight / weight.sum(1, keepdims=True).clip(1e-300), doc, n) / size
    gain = np.log((likely * share[doc]).sum(1).clip(1e-300)) + top[:, 0]
    return share, _by_doc(gain, doc, n)


def mixtures(scores: np.ndarray, doc: np.ndarray, n_docs: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents at once: proportions by document, the language of each sentence, and how sure it
    is, by a posterior that leaves every language a tenth in all. doc: each sentence's document,
    ascending. Languages whose loss costs less than PENALTY leave the mixture, one a round."""
    k = scores.shape[1]
    allowed = np.zeros((n_docs, k), bool)
    allowed[doc, scores.argmax(1)] = True
    share = allowed.astype(float)
    many = np.flatnonzero(allowed.sum(1) > 1)
    while len(many):
        at = np.flatnonzero(np.isin(doc, many))
        where = np.searchsorted(many, doc[at])
        share[many], full = _fit(scores[at], where, len(many), allowed[many], rounds)
        loss = np.full((len(many), k), np.inf)
        for code in np.flatnonzero(allowed[many].any(0)):
            tried = np.flatnonzero(allowed[many, code])
            inside = np.isin(where, tried)
            mask = allowed[many[tried]]
            mask[:, code] = False
            without = _fit(scores[at][inside], np.searchsorted(tried, where[inside]), len(tried), mask, rounds)[1]
            loss[tried, code] = full[tried] - without
        worst = loss.argmin(1)
        drop = loss[np.arange(len(many)), worst] < PENALTY
        allowed[many[drop], worst[drop]] = False
        many = many[drop]
        one = many[allowed[many].sum(1) == 1]
        share[one] = allowed[one]
        many = np.setdiff1d(many, one)
    with np.errstate(divide="ignore"):
        best = (scores + np.log(share)[doc]).argmax(1)
    joint = scores + np.log(0.9 * share + 0.1 / k)[doc]
    weight = np.exp(joint - joint.max(1, keepdims=True))
    return share, best, (weight[np.arange(len(doc)), best] / weight.sum(1))


def training_sample(docs: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """Whole labelled documents, about per_language at most of each language, drawn by hash of the id."""
    labelled = docs.filter(F.length("text") > 0).select("doc_id", "text", label_language(F.col("lang")).alias("code")).filter("code IS NOT NULL")
    total = {r.code: r["count"] for r in docs.select(label_language(F.col("lang")).alias("code")).filter("code IS NOT NULL").groupBy("code").count().toLocalIterator()}  # ten rows
    spread, chosen = 1_000_000, F.lit(False)
    for code, n in sorted(total.items()):
        chosen = chosen | ((F.col("code") == code) & (F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < int(spread * min(1.0, per_language / n))))
    return sorted((r.text, r.code) for r in labelled.filter(chosen).select("text", "code").toLocalIterator())


_RESULT = """doc_id long, label string, named string, languages array<struct<lang:string,sentences:int,share:double,confidence:double>>,
segments array<struct<lang:string,confidence:double,sentences:int,text:string>>"""


def language_profiles(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, label, named (the language the label names, or null), languages (all with a sentence) and
    segments (runs of sentences of one language, with their text), a row per row of docs.

    Null and empty texts and texts without sentences have no languages and no segments. The model is
    trained on training_sample() unless given; it's a table of n-grams whose size the sample bounds.
    No shuffle: each document is read once, whole.
    """
    model = model or train(training_sample(docs))
    table, row = model.table, model.row
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    shared = docs.sparkSession.sparkContext.broadcast((table, row))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model.__new__(Model)
        mine.table, mine.row = shared.value
        mine.forget()
        schema = pa.schema(
            [
                ("doc_id", pa.int64()), ("label", pa.string()), ("named", pa.string()),
                ("languages", pa.list_(pa.struct([("lang", pa.string()), ("sentences", pa.int32()), ("share", pa.float64()), ("confidence", pa.float64())]))),
                ("segments", pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("text", pa.string())]))),
            ]
        )
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(2).to_pylist()
                each = [whole_sentences(t) if t else [] for t in texts]
                doc = np.repeat(np.arange(len(each)), [len(s) for s in each])
                flat = [s for sentences in each for s in sentences]
                languages: list[list[dict]] = [[] for _ in each]
                segments: list[list[dict]] = [[] for _ in each]
                if flat:
                    share, best, sure = mixtures(mine.scores(flat), doc, len(each))
                    seen: list[dict[int, list[float]]] = [{} for _ in each]
                    last = (-1, -1)
                    for s, d, k, p in zip(flat, doc.tolist(), best.tolist(), sure.tolist(), strict=True):
                        seen[d].setdefault(k, []).append(p)
                        if last == (d, k):
                            run = segments[d][-1]
                            run["confidence"] += p
                            run["sentences"] += 1
                            run["text"] += " " + s
                        else:
                            segments[d].append({"lang": LANGUAGES[k], "confidence": p, "sentences": 1, "text": s})
                        last = (d, k)
                    for d, by in enumerate(seen):
                        languages[d] = [
                            {"lang": LANGUAGES[k], "sentences": len(p), "share": round(float(share[d, k]), 6), "confidence": round(sum(p) / len(p), 6)}
                            for k, p in sorted(by.items(), key=lambda x: (-len(x[1]), x[0]))
                        ]
                        for run in segments[d]:
                            run["confidence"] = round(run["confidence"] / run["sentences"], 6)
                labels = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(labels, pa.string()), pa.array([named_language(x) for x in labels], pa.string()), pa.array(languages, schema.field(3).type), pa.array(segments, schema.field(4).type)],
                    schema=schema,
                )

    return rows.mapInArrow(profile, _RESULT)


def own_languages(profiles: DataFrame) -> DataFrame:
    """doc_id, label, named, lang, confidence: a row for each language with WHOLE sentences or more."""
    own = F.filter("languages", lambda x: x["sentences"] >= WHOLE)
    return profiles.select("doc_id", "label", "named", F.size(own).alias("n_languages"), F.array_contains(F.transform(own, lambda x: x["lang"]), F.col("named")).alias("label_is_own"), F.explode(own).alias("x")).select(
        "doc_id", "label", "named", "n_languages", "label_is_own", "x.lang", "x.sentences", "x.share", "x.confidence"
    )


def mislabelled(profiles: DataFrame) -> DataFrame:
    """The own languages of the documents whose label is missing or wrong, or that have several."""
    return own_languages(profiles).filter(F.col("n_languages").__gt__(1) | ~F.coalesce("label_is_own", F.lit(False)))
