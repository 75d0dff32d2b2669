"""The record of an experiment as Markdown."""

from __future__ import annotations

from datetime import date

from plumbline.operators.metrics import NAMES
from plumbline.operators.models import CANDIDATES
from plumbline.operators.sanitize import Report
from plumbline.plans.experiment import Result
from plumbline.plans.narrate import WORDS, direction_word
from plumbline.sources.scored_csv import slug


#: Names of months, by language.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}


def long_date(day: date, locale: str = "en") -> str:
    month = MONTHS[locale][day.month - 1]
    return f"{month} {day.day}, {day.year}" if locale == "en" else f"{day.day} de {month} de {day.year}"


def model_card(result: Result, dataset: str, columns: int, day: date, sanitation: Report | None = None, narrative: str | None = None, locale: str = "en") -> str:
    """Data, sanitation, split, method, test metrics, verdict, leaks, importances, narrative and limits; the date and directions in the language of ``locale``."""
    spec, words = result.spec, WORDS[locale]
    model, majority, logistic = (result.scores[m] for m in (result.winner, "majority", "logistic"))
    lines = [f"# Model card: {dataset}", "", f"Made on {long_date(day, locale)}.", "", "## Data", ""]
    lines += [f"- {spec.rows} rows, {columns} columns ({len(spec.numeric)} numeric and {len(spec.categorical)} categorical features)"]
    lines += [f"- Target: {spec.target}; positive class: {spec.positive}; positive rate {spec.positive_rate:.2f}"]
    if spec.dropped_null_targets:
        lines += [f"- {spec.dropped_null_targets} rows without a target were left out"]
    if sanitation and not sanitation.clean:
        lines += ["", "## Sanitation", ""]
        lines += [f"- {sanitation.duplicates} repeated rows removed"] if sanitation.duplicates else []
        lines += [f"- {c} left out ({why})" for c, why in sanitation.exclusions] + [f"- {c}: {n} cells emptied" for c, n in sanitation.coercions]
    lines += ["", "## Split", "", f"- {result.train_rows} training and {result.test_rows} test rows, stratified, seed {spec.seed}", "- Preprocessing was fitted on training rows only."]
    lines += ["", "## Method", "", f"- Baselines: majority, logistic. Candidates: {', '.join(CANDIDATES)}. Chosen: {result.winner}."]
    if rare := result.statistics.rare:
        lines += ["- Rare categories grouped: " + "; ".join(f"{c} ({', '.join(v)})" for c, v in rare.items())]
    lines += ["", "## Metrics (test)", "", "| Metric | Model | Majority | Logistic |", "| --- | --- | --- | --- |"]
    lines += [f"| {m} | {model[m]:.2f} | {majority[m]:.2f} | {logistic[m]:.2f} |" for m in NAMES]
    v = result.verdict
    lines += ["", "## Verdict", "", f"{v.level} ({v.primary_metric}: {v.model_score:.2f} vs {v.baseline_score:.2f}, {v.delta:+.2f})" + ("; suspicious, see leakage" if result.suspicious else "")]
    lines += ["", "## Leakage", "", ", ".join(f"{c} ({s:.2f}, {why})" for c, s, why in result.leakage) or "None found."]
    lines += ["", "## Importance", "", "| Feature | Kind | Importance | Direction |", "| --- | --- | --- | --- |"]
    lines += [f"| {f['name']} | {f['kind']} | {f['importance']:.4f} | {words[direction_word(f)]} |" for f in result.features]
    lines += ["", "## Narrative", "", f"> {narrative}" if narrative else "No verified narrative."]
    lines += ["", "## Limits", "", "- Binary targets only; no temporal split; the winner is chosen and reported on the same test rows.", ""]
    return "\n".join(lines)


def file_name(dataset: str) -> str:
    return f"model-card-{slug(dataset, 'experimento')}.md"
