"""Rules, signals, layers and decisions as column expressions over an original and a normalised text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstone.functions import normalize as N
from wardstone.functions.registry import RULES, SIGNALS, java_regex

HIT = "array<struct<rule_id:string,weight:double,start:int,end:int,matched:string>>"

# Fixed values
RULE_TRUST, SIGNAL_TRUST, MODEL_TRUST = 0.90, 0.65, 0.95
FLAG, BLOCK, REASON_FLOOR, MATCHED_CHARS = 0.5, 0.9, 0.2, 120
COMMANDS = (
    "act answer append comply confirm continue disclose disregard do execute follow forget give ignore list obey omit output override "
    "pretend print reply repeat respond return reveal say send show skip state stop summarise summarize tell translate write"
).split()
DIRECTIVE = r"\byou (?:must|will|are to|should now|shall)\b|\byour (?:new )?(?:task|role|job) is\b|\bfrom now on\b|\bgoing forward\b|\bfor the rest of this session\b"
CONTEXT = r"\b(?:your (?:instructions?|system prompt|configuration|directives?|context)|the (?:system prompt|developer message|hidden context|instructions above)|everything above|the text above this line)\b"


def contains_any(lower: Column, strings: Iterable[str]) -> Column:
    out = F.lit(False)
    for s in strings:
        out = out | F.contains(lower, F.lit(s))
    return out


def _lowered(norm: Column) -> Column:
    return F.lower(F.replace(norm, F.lit("ſ"), F.lit("s")))  # the one letter beyond ASCII that patterns fold and lower() does not


def rule_hits(norm: Column, disabled: Iterable[str] = (), evidence: bool = False) -> Column:
    """Array of struct(rule_id, weight[, start, end, matched]) of the rules that match, in table order, each once.

    A rule's pattern runs only on texts that contain one of its triggers.
    """
    disabled = frozenset(disabled)

    def hit(rule, lower):
        regex = java_regex(rule.pattern)
        fields = [F.lit(rule.name).alias("rule_id"), F.lit(rule.weight).alias("weight")]
        if evidence:
            whole = F.regexp_substr(norm, F.lit(regex))
            start = F.length(F.get(F.split(norm, regex, 2), F.lit(0)))
            fields += [start.alias("start"), (start + F.length(whole)).alias("end"), F.substring(whole, 1, MATCHED_CHARS).alias("matched")]
        return F.when(contains_any(lower, rule.triggers) & norm.rlike(regex), F.struct(*fields))

    on = [r for r in RULES if r.name not in disabled]
    if not on:
        return F.array().cast(HIT if evidence else "array<struct<rule_id:string,weight:double>>")
    return N.let(_lowered(norm), lambda lower: F.filter(F.array(*[hit(r, lower) for r in on]), lambda x: x.isNotNull()))


def _share(count: Column, of: Column, factor: float = 1.0) -> Column:
    return F.when(of > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), count / of * factor))).otherwise(0.0)


def zero_width_signal(original: Column) -> Column:
    return _share(F.length(original) - F.length(N.zero_width(original)), F.length(original), 50)


def script_mixing_signal(original: Column) -> Column:
    """Words with letters of two of Latin (without the fullwidth block), Cyrillic and Greek, times four."""
    words = F.regexp_extract_all(original, F.lit(r"\p{L}+"), F.lit(0))
    scripts = (r"[\p{IsLatin}&&[^Ａ-Ｚａ-ｚ]]", r"\p{IsCyrillic}", r"\p{IsGreek}")
    two = lambda c: sum((c.rlike(s).cast("int") for s in scripts), F.lit(0)) >= 2
    # most texts hold one script, and none of their words can mix two
    return F.when(two(original), N.let(words, lambda w: _share(F.size(F.filter(w, two)), F.size(w), 4))).otherwise(0.0)


def encoded_blob_signal(original: Column) -> Column:
    runs = F.regexp_extract_all(original, F.lit(f"{N.BASE64_RUN}|{N.HEX_RUN_POSSESSIVE}"), F.lit(0))
    return _share(F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x)), F.length(original), 3)


def expansion_signal(original: Column, norm: Column) -> Column:
    return _share(F.length(norm) - F.length(original), F.length(original), 2)


#: Where a sentence that is not blank begins, and one whose first run of letters is a command
SENTENCE = r"(?U)(?<![^.!?\n])[^.!?\n]*[^.!?\n\s]"
COMMAND = r"(?<![^.!?\n])[^.!?\n\p{L}]*" + N.any_word(COMMANDS) + r"(?!\p{L})"


def imperative_signal(norm: Column) -> Column:
    """Share of sentences whose first word is a command."""
    return _share(F.regexp_count(F.lower(norm), F.lit(COMMAND)), F.regexp_count(norm, F.lit(SENTENCE)))


def _half_count(c: Column, pattern: str, triggers: Iterable[str], first: str) -> Column:
    """Half the number of matches, 1 at most. first: the letters that a match can begin with; elsewhere no word boundary is looked for."""
    led = f"(?=[{first}{first.upper()}])(?:{java_regex(pattern)})"
    return F.when(contains_any(_lowered(c), triggers), F.least(F.lit(1.0), F.regexp_count(c, F.lit(led)) / 2)).otherwise(0.0)


def signal_values(original: Column, norm: Column) -> dict[str, Column]:
    return {
        "structure.zero_width": zero_width_signal(original),
        "structure.script_mixing": script_mixing_signal(original),
        "structure.encoded_blob": encoded_blob_signal(original),
        "structure.expansion": expansion_signal(original, norm),
        "structure.imperative": imperative_signal(norm),
        "structure.directive": _half_count(norm, DIRECTIVE, ("you ", "your ", "from now on", "going forward", "for the rest of this session"), "yfg"),
        "structure.context_reference": _half_count(norm, CONTEXT, ("your ", "system prompt", "developer message", "hidden context", "instructions above", "everything above", "the text above"), "yte"),
    }


def signal_hits(original: Column, norm: Column, disabled: Iterable[str] = ()) -> Column:
    """Array of struct(name, value, weight) of the signals above zero, in table order."""
    value, disabled = signal_values(original, norm), frozenset(disabled)
    found = [F.struct(F.lit(s.name).alias("name"), value[s.name].cast("double").alias("value"), F.lit(s.weight).alias("weight")) for s in SIGNALS if s.name not in disabled]
    return F.filter(F.array(*found), lambda x: x.value > 0) if found else F.array().cast("array<struct<name:string,value:double,weight:double>>")


def noisy_or(values: Column) -> Column:
    """1 - product of (1 - value), values clamped to [0, 1]; 0 for none."""
    return 1 - F.aggregate(values, F.lit(1.0), lambda a, v: a * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))))


def rule_layer(hits: Column) -> Column:
    return noisy_or(F.transform(hits, lambda h: h.weight))


def signal_layer(hits: Column) -> Column:
    return noisy_or(F.transform(hits, lambda h: h.weight * h.value))


def combined_layer(rules: Column, signals: Column, model: Column) -> Column:
    return noisy_or(F.array(rules * RULE_TRUST, signals * SIGNAL_TRUST, model * MODEL_TRUST))


def decision_score(rules: Column, signals: Column, model: Column | None = None) -> Column:
    """The model's score where one is loaded, else the noisy or of the trusted rule and signal layers."""
    return noisy_or(F.array(rules * RULE_TRUST, signals * SIGNAL_TRUST)) if model is None else model


def decide(score: Column, enforce: bool = False, flag: float = FLAG, block: float = BLOCK) -> Column:
    if not 0 <= flag <= block <= 1:
        raise ValueError("thresholds need 0 <= flag <= block <= 1")
    out = F.when(score >= flag, "flag").otherwise("allow")
    return F.when(score >= block, "block").otherwise(out) if enforce else out


def reasons(rules: Column, signals: Column) -> Column:
    loud = F.filter(signals, lambda s: s.value >= REASON_FLOOR)
    return F.concat(F.transform(rules, lambda h: h.rule_id), F.transform(loud, lambda s: F.format_string("%s=%.2f", s["name"], s.value)))


def explain(decision: Column, score: Column, why: Column) -> Column:
    return F.format_string("%s at %.3f (%s)", decision, score, F.when(F.size(why) > 0, F.array_join(why, ", ")).otherwise("no reasons"))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def fingerprint(text: Column, salt: str) -> Column:
    """A salted digest that stands for a text in logs."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\0"), text), 256), 1, 32))
