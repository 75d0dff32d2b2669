"""Words about a result, made of aggregates alone, and the check that words are true."""

from __future__ import annotations

import math
import time
import unicodedata
from collections import deque
from collections.abc import Callable

from plumbline.plans.experiment import Result

TOP_PAYLOAD, TOP_TEMPLATE = 8, 3
TOLERANCE = 0.005
#: Bounds of a request. The compatible profile bounds the rows too; tables of any size are described otherwise.
MAX_COLUMNS, MAX_LEAKS, MAX_ALERTS, COMPATIBLE_ROWS = 10_000, 8, 20, 1_000_000
#: Longest names, fewest and most characters of a narrative, and claims at most.
MAX_NAME, NARRATIVE, MAX_CLAIMS = 120, (40, 1200), 5
#: Grades from which a narrative passes.
GRADES = {"accuracy": 4, "completeness": 3, "clarity": 3}
METRICS = ["accuracy", "precision", "recall", "f1", "auc"]

#: What the standard text is made of, by language.
WORDS = {
    "en": {
        "beats": "On rows kept from training, {metric} is {model}; the best simple rule reaches {baseline}, which is {delta} less.",
        "ties": "On rows kept from training, {metric} is {model} and the best simple rule reaches {baseline}: there is nothing to choose between them.",
        "loses": "On rows kept from training, {metric} is only {model}, and the best simple rule reaches {baseline}: use the rule.",
        "note": "{metric} was what counted, {help}.",
        "f1": "a figure that is high only where most positives are found and most finds are right",
        "auc": "the share of pairs of one row from each class that come in the right order, half of them by guessing",
        "features": "Most depended on {list}.",
        "positive": "more of it speaks for the positive class",
        "negative": "more of it speaks against the positive class",
        "categorical": "each category has its own effect",
        "unclear": "up or down makes no steady difference",
        "unused": "hardly counted",
        "method": "That was judged by how much worse the test rows fared once a column's values had changed places.",
        "leakage": "Beware: whoever knows {columns} may know the result already, so expect less than these figures in use.",
        "id-like": "Nearly every row has its own value of {columns}, which says nothing about new rows.",
        "imbalance": "No more than {rate}% of the rows are of the rarer class, so right answers alone would prove little.",
    },
    "es": {
        "beats": "Con filas reservadas para la prueba, {metric} vale {model}; la mejor regla sencilla llega a {baseline}, es decir, {delta} menos.",
        "ties": "Con filas reservadas para la prueba, {metric} vale {model} y la mejor regla sencilla llega a {baseline}: da lo mismo usar una u otro.",
        "loses": "Con filas reservadas para la prueba, {metric} vale solo {model}, y la mejor regla sencilla llega a {baseline}: conviene la regla.",
        "note": "Se comparó por {metric}, {help}.",
        "f1": "cifra alta solo cuando se encuentran casi todos los positivos y casi todo lo encontrado es cierto",
        "auc": "la parte de las parejas, con una fila de cada clase, que quedan bien ordenadas; adivinando sería la mitad",
        "features": "Pesaron sobre todo {list}.",
        "positive": "cuanto mayor, más apunta a la clase positiva",
        "negative": "cuanto mayor, menos apunta a la clase positiva",
        "categorical": "cada categoría influye a su manera",
        "unclear": "subir o bajar no cambia nada estable",
        "unused": "apenas contó",
        "method": "Se juzgó por cuánto empeoran las filas de prueba al intercambiar los valores de una columna.",
        "leakage": "Cuidado: quien conoce {columns} quizá ya conoce el resultado; en la práctica cabe esperar menos.",
        "id-like": "Casi cada fila tiene su propio valor de {columns}, y eso no dice nada de filas nuevas.",
        "imbalance": "Apenas el {rate}% de las filas son de la clase menos frecuente; acertar mucho demostraría poco.",
    },
}
#: The text where a payload is not one.
NOTHING = {"en": "There are no figures that a text could be made of.", "es": "No hay cifras de las que hacer un texto."}


def rounded(x: float, places: int) -> float:
    """x rounded half up."""
    return math.floor(x * 10**places + 0.5) / 10**places


def unit(x: float) -> float:
    return min(1.0, max(0.0, rounded(x, 4)))


def payload(result: Result, columns: int, alerts: list[dict] | None = None, locale: str = "en") -> dict:
    """Names and aggregates only: no cell of the table, not even the positive class."""
    v = result.verdict
    out = {
        "locale": locale,
        "problem": "binary-classification",
        "target": result.spec.target,
        "dataset": {"rows": result.train_rows + result.test_rows, "cols": columns},
        "metrics": {k: unit(x) for k, x in result.scores[result.winner].items()},
        "verdict": {"level": v.level, "primary_metric": v.primary_metric, "model_score": unit(v.model_score), "baseline_score": unit(v.baseline_score), "delta": rounded(v.delta, 4)},
        "explainability": {"method": "permutation", "scoring": result.scoring, "features": [{k: rounded(f[k], 3) if k == "importance" else f[k] for k in ("name", "kind", "importance", "direction")} for f in result.features[:TOP_PAYLOAD]]},
        # The strongest first, as they stand.
        "leakage": [column for column, _, _ in result.leakage[:MAX_LEAKS]],
    }
    if alerts:
        out["eda"] = [{"kind": a["kind"], "minority_rate": unit(a["minority_rate"])} if a["kind"] == "class-imbalance" else {"kind": a["kind"], "column": a["column"]} for a in alerts[:MAX_ALERTS]]
    return out


def _name(x: object) -> bool:
    return isinstance(x, str) and 1 <= len(x) <= MAX_NAME


def _number(low: float, high: float, kind: type | tuple = (int, float)) -> Callable[[object], bool]:
    return lambda x: isinstance(x, kind) and not isinstance(x, bool) and low <= x <= high


def _one_of(*values: object) -> Callable[[object], bool]:
    return lambda x: any(x is v or (isinstance(x, str) and x == v) for v in values)


def _only(**fields: Callable[[object], bool]) -> Callable[[object], bool]:
    """Whether an object has these fields and no others, each as it should be."""
    return lambda x: isinstance(x, dict) and set(x) == set(fields) and all(ok(x[k]) for k, ok in fields.items())


def _list(least: int, most: int, ok: Callable[[object], bool]) -> Callable[[object], bool]:
    return lambda x: isinstance(x, list) and least <= len(x) <= most and all(map(ok, x))


_SHARE, _SIGNED, _LEVEL = _number(0, 1), _number(-1, 1), _one_of("beats", "ties", "loses")
_FEATURE = _only(name=_name, kind=_one_of("numeric", "categorical"), importance=_SIGNED, direction=_one_of("positive", "negative", None))
_ALERTS = [_only(kind=_one_of("possible-leak", "id-like"), column=_name), _only(kind=_one_of("class-imbalance"), minority_rate=_SHARE)]


def check_request(p: object, max_rows: int | None = None) -> bool:
    """Whether a payload is of the closed vocabulary and within its bounds: a field too many, of any kind, and it is not."""
    fields = {
        "locale": _one_of(*WORDS),
        "problem": _one_of("binary-classification"),
        "target": _name,
        "dataset": _only(rows=_number(1, math.inf if max_rows is None else max_rows, int), cols=_number(1, MAX_COLUMNS, int)),
        "metrics": _only(**dict.fromkeys(METRICS, _SHARE)),
        "verdict": _only(level=_LEVEL, primary_metric=_one_of(*METRICS), model_score=_SHARE, baseline_score=_SHARE, delta=_SIGNED),
        "explainability": _only(method=_one_of("permutation"), scoring=lambda x: _name(x) and len(x) <= 40, features=_list(1, TOP_PAYLOAD, _FEATURE)),
        "leakage": _list(0, MAX_LEAKS, _name),
    }
    if isinstance(p, dict) and "eda" in p:
        fields["eda"] = _list(0, MAX_ALERTS, lambda x: any(ok(x) for ok in _ALERTS))
    return _only(**fields)(p)


def check_output(output: object) -> bool:
    """Whether a narrator's answer has a level, a narrative and claims within their bounds."""
    claim = _only(feature=_name, direction=_one_of("positive", "negative", "none"), importance=_SIGNED)
    text = lambda x: isinstance(x, str) and NARRATIVE[0] <= len(x) <= NARRATIVE[1]
    return _only(verdict_level=_LEVEL, narrative=text, claims=_list(1, MAX_CLAIMS, claim))(output)


def check_grade(grade: object) -> bool:
    return _only(**dict.fromkeys(GRADES, _number(1, 5, int)))(grade)


def direction_word(feature: dict) -> str:
    if rounded(feature["importance"], 3) <= 0:
        return "unused"
    return "categorical" if feature["kind"] == "categorical" else feature["direction"] or "unclear"


def standard_text(p: dict) -> str:
    """The text that always exists: made from the payload by rule, whatever the sizes in it."""
    words, v = WORDS[p["locale"]], p["verdict"]
    metric = v["primary_metric"].upper()
    listed = " · ".join(f"{f['name']} ({words[direction_word(f)]})" for f in p["explainability"]["features"][:TOP_TEMPLATE])
    parts = [
        words[v["level"]].format(model=f"{v['model_score']:.2f}", baseline=f"{v['baseline_score']:.2f}", metric=metric, delta=f"{abs(v['delta']):.2f}"),
        words["note"].format(metric=metric, help=words[v["primary_metric"]]),
        words["features"].format(list=listed),
        words["method"],
    ]
    if p["leakage"]:
        parts.append(words["leakage"].format(columns=", ".join(p["leakage"])))
    alerts = p.get("eda", [])
    if ids := [a["column"] for a in alerts if a["kind"] == "id-like"]:
        parts.append(words["id-like"].format(columns=", ".join(ids)))
    parts += [words["imbalance"].format(rate=f"{100 * a['minority_rate']:.0f}") for a in alerts if a["kind"] == "class-imbalance"][:1]
    return " ".join(parts)


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ").lower()


def verify(p: dict, output: dict) -> str | None:
    """Why a narrative (verdict_level, narrative, claims) must not be shown, or None."""
    if output["verdict_level"] != p["verdict"]["level"]:
        return "wrong-verdict"
    known, said = {f["name"]: f for f in p["explainability"]["features"]}, folded(output["narrative"])
    for claim in output["claims"]:
        fact = known.get(claim["feature"])
        checks = [
            ("unknown-feature", fact is not None),
            ("wrong-direction", fact and claim["direction"] == (fact["direction"] or "none")),
            ("wrong-importance", fact and abs(claim["importance"] - fact["importance"]) <= TOLERANCE),
            ("claim-not-in-narrative", folded(claim["feature"]) in said),
        ]
        if failed := next((why for why, holds in checks if not holds), None):
            return failed
    silent = set(known) - {c["feature"] for c in output["claims"]}
    return "unclaimed-feature-mention" if any(folded(x) in said for x in silent) else None


def passes(grade: dict[str, int]) -> bool:
    return all(grade[k] >= least for k, least in GRADES.items())


class RateLimit:
    """At most ``hits`` in any ``seconds``, for each key, in one process; ``streaming.limits`` has it for a cluster.

    Keys without a request in the last window are forgotten, at the cost of one pass in each window.
    """

    def __init__(self, hits: int = 10, seconds: float = 60.0):
        self.hits, self.seconds, self.seen, self.swept = hits, seconds, {}, None

    def allow(self, key: str, now: float | None = None) -> bool:
        now = time.monotonic() if now is None else now
        if self.swept is None or now - self.swept >= self.seconds:
            self.seen = {k: x for k, x in self.seen.items() if x and x[-1] > now - self.seconds}
            self.swept = now
        past = self.seen.setdefault(key, deque())
        while past and past[0] <= now - self.seconds:
            past.popleft()
        if len(past) >= self.hits:
            return False
        past.append(now)
        return True


def cost(prices: dict[str, tuple[float, float]], model: str, tokens_in: int, tokens_out: int) -> float:
    """Cost in US dollars at prices per million tokens in and out; an unknown model costs 0."""
    a, b = prices.get(model, (0.0, 0.0))
    return (tokens_in * a + tokens_out * b) / 1e6


def narrate(p: dict, provider: Callable[[dict], dict] | None, grader: Callable[[dict, dict], dict] | None = None, limit: RateLimit | None = None, key: str = "", max_rows: int | None = None) -> dict:
    """A verified narrative, or why the standard text stands: unavailable, limited, invalid, provider or rejected."""

    def text(why: str) -> dict:
        try:
            return {"ok": False, "reason": why, "text": standard_text(p)}
        except (KeyError, TypeError, ValueError, AttributeError):
            return {"ok": False, "reason": why, "text": NOTHING.get(p.get("locale") if isinstance(p, dict) else None, NOTHING["en"])}

    if provider is None:
        return text("unavailable")
    if limit is not None and not limit.allow(key):
        return text("limited")
    if not check_request(p, max_rows):
        return text("invalid")
    try:
        output = provider(p)
        if not check_output(output):
            return text("provider")
        if verify(p, output):
            return text("rejected")
        grade = None if grader is None else grader(p, output)
        if grade is not None and not (check_grade(grade) and passes(grade)):
            return text("rejected")
    except Exception:  # noqa: BLE001  a provider may fail in any way
        return text("provider")
    return {"ok": True, "text": output["narrative"]}


def mock_provider(p: dict) -> dict:
    """A deterministic narrator for tests: the standard text, and true claims for all that it names."""
    text = standard_text(p)
    claims = [{"feature": f["name"], "direction": f["direction"] or "none", "importance": f["importance"]} for f in p["explainability"]["features"] if folded(f["name"]) in folded(text)][:MAX_CLAIMS]
    return {"verdict_level": p["verdict"]["level"], "narrative": text, "claims": claims}
