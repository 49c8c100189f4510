"""Rules, stages, signals and families as data: what each is called, weighs and was motivated by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FAMILIES = (
    "direct_override", "role_assumption", "delimiter_escape", "encoding_wrapper", "homoglyph", "indirect", "exfiltration",
    "refusal_suppression", "payload_splitting", "translation_pivot", "hypothetical", "authority_claim",
)


@dataclass(frozen=True)
class Countermeasure:
    name: str
    weight: float
    motivated_by: tuple[str, ...]
    pattern: str = ""
    #: Lower-case strings one of which every match contains: a cheap test before the pattern
    triggers: tuple[str, ...] = ()


def any_of(*options: str) -> str:
    return "(?:" + "|".join(options) + ")"


def whole(*options: str) -> str:
    """One of the options with word boundaries on both sides."""
    return r"\b" + any_of(*options) + r"\b"


def lead(*options: str) -> str:
    """One of the options with a word boundary before it."""
    return r"\b" + any_of(*options)


GAP = r".{0,60}?"

# The words below decide which messages a rule finds.
_OVERRIDE = ("ignore", "disregard", "forget", "set aside", "override", "discard", "bypass", "suspend")
_SCOPE = ("previous", "prior", "earlier", "above", "original", "preceding", "foregoing")
_DISCLOSE = ("reveal", "show", "print", "output", "repeat", "disclose", "list", "summari[sz]e", "state")
_HIDDEN = ("system prompt", "initial instructions", "your instructions", "context window", "developer message", "hidden context", "configuration values", "credentials this session")
_AUTHORITY = ("system administrator", "the developer who deployed you", "the security team", "the compliance reviewer", "the on-call engineer", "the platform's trust and safety lead", "the person who wrote your system prompt")
_FICTION = ("story", "screenplay", "fictional", "hypothetical", "thought experiment", "novel", "in character")
_LIMITS = ("restrictions?", "filters?", "policy", "policies", "guardrails?", "limits?")

RULES = (
    Countermeasure("override.verb_scope", 0.55, ("direct_override",), whole(*_OVERRIDE) + r"(?:\s+\w+){0,3}\s+" + whole(*_SCOPE), _OVERRIDE),
    Countermeasure("override.instruction_noun", 0.30, ("direct_override",), lead("previous", "prior", "earlier", "original", "preceding") + r"\s+" + any_of("instructions?", "directives?", "rules?", "prompts?", "configuration", "policy") + r"\b", ("previous", "prior", "earlier", "original", "preceding")),
    Countermeasure("override.new_task", 0.40, ("direct_override",), whole("your new (?:task|instruction|role) is", "the real instruction is", "for the rest of this session, you", "from now on,? you (?:must|will|are)"), ("your new ", "the real instruction is", "for the rest of this session", "from now on")),
    Countermeasure("role.you_are_now", 0.35, ("role_assumption",), whole("you are now", "you will now act as", "pretend (?:to be|you are)", "act as if you (?:are|were)", "from now on you are"), ("you are now", "you will now act", "pretend ", "act as if you", "from now on you are")),
    Countermeasure("role.unrestricted", 0.45, ("role_assumption",), whole("(?:no|without|free of) " + any_of(*_LIMITS), "unrestricted (?:mode|assistant|version|model)", "developer mode", "debug console", "no opinions"), ("restriction", "filter", "polic", "guardrail", "limit", "unrestricted", "developer mode", "debug console", "no opinions")),
    Countermeasure("delimiter.close_tag", 0.45, ("delimiter_escape",), any_of("</" + any_of("system", "instructions?", "context", "prompt") + ">", r"<\|im_(?:start|end)\|>"), ("</", "<|im_")),
    Countermeasure("delimiter.forged_header", 0.40, ("delimiter_escape",), r"^(?:\s*(?:#{1,3}|-{2,})\s*)?" + any_of("system override", "new system message", "system:", r"\[system\]", "<system>"), ("system override", "new system message", "system:", "[system]", "<system>")),
    Countermeasure("delimiter.end_marker", 0.35, ("delimiter_escape",), any_of(r"\[?\s*end of " + any_of("document", "context", "input", "user input") + r"\s*\]?", r"-{2,}\s*end of context\s*-{2,}"), ("end of ",)),
    Countermeasure("encoding.decode_and_obey", 0.60, ("encoding_wrapper",), whole("decode", "decrypt", "un-?rot13", "apply rot13", "read") + GAP + lead("and", "then") + r"\s+" + any_of("do what it says", "follow", "obey", "comply", "carry out", "execute") + r"\b", ("do what it says", "follow", "obey", "comply", "carry out", "execute")),
    Countermeasure("encoding.read_backwards", 0.50, ("encoding_wrapper",), whole("read (?:this|the following|it) backwards"), ("backwards",)),
    Countermeasure("exfil.reveal_prompt", 0.60, ("exfiltration",), whole(*_DISCLOSE) + GAP + whole(*_HIDDEN), _HIDDEN),
    Countermeasure("exfil.channel", 0.35, ("exfiltration",), whole("markdown image", "image whose url contains", "as a link i can click", "encoded in base64 so it renders"), ("markdown image", "image whose url", "as a link i can", "encoded in base64")),
    Countermeasure("exfil.repeat_above", 0.50, ("exfiltration",), whole("repeat everything above", "print the first line of your instructions", "list every directive you were given", "output the full text of your configuration"), ("repeat everything above", "print the first line of", "list every directive", "output the full text")),
    Countermeasure("refusal.suppression", 0.45, ("refusal_suppression",), whole("do not apologi[sz]e", "never say (?:that )?you (?:can'?t|cannot)", "omit (?:every|all) disclaimers?", "do not add warnings", "do not mention any policy", "never begin with", "skip the part where you explain your limits", "leave out the safety note"), ("do not apologi", "never say ", "omit ", "do not add warnings", "do not mention any", "never begin with", "skip the part", "leave out the safety")),
    Countermeasure("split.assemble", 0.55, ("payload_splitting",), whole("concatenate", "join", "combine") + GAP + whole("treat the result as", "as your instruction", "and follow (?:it|the result)"), ("treat the result as", "as your instruction", "and follow ")),
    Countermeasure("hypothetical.no_rules", 0.35, ("hypothetical",), whole(*_FICTION) + GAP + r"\b" + any_of("no (?:rules|restrictions)", "removed", "without (?:any )?(?:restrictions?|policy|policies)"), ("no rules", "no restrictions", "removed", "without ")),
    Countermeasure("authority.claim", 0.40, ("authority_claim",), r"\bthis is (?:the )?" + any_of(*_AUTHORITY) + r"\b", ("this is ",)),
    Countermeasure("authority.authorise", 0.45, ("authority_claim",), whole("i authorise you to", "you are authorised to (?:ignore|bypass|override)", "maintenance window is open", "change request approved", "this is a sanctioned test"), ("i authorise you", "you are authorised", "maintenance window is", "change request approved", "sanctioned test")),
    Countermeasure("indirect.addressed_to_model", 0.65, ("indirect",), whole("note (?:for|to) any ai (?:assistant|model)", "to the model (?:processing|reading)", "automated systems:", "if you are a language model", "assistant instructions embedded"), ("any ai ", "to the model ", "automated systems:", "if you are a language model", "assistant instructions embedded")),
    Countermeasure("translate.then_obey", 0.55, ("translation_pivot",), r"\btranslate the following\b" + GAP + r"\bthen " + any_of("carry out", "do", "follow", "obey") + r"\b", ("translate the following",)),
    Countermeasure("translate.foreign_override", 0.60, ("translation_pivot",), any_of("ignorez toutes les instructions", "ignora todas las instrucciones", "ignoriere alle vorherigen", "ignora tutte le istruzioni", "ignore todas as instrucoes", "negeer alle voorgaande"), ("ignorez ", "ignora ", "ignoriere ", "ignore todas", "negeer ")),
)

#: Normalisation stages in order; weight has no meaning for them.
STAGES = tuple(Countermeasure(name, 0.0, by) for name, by in (("nfkc", ("homoglyph",)), ("zero_width", ("homoglyph",)), ("confusables", ("homoglyph",)), ("whitespace", ()), ("decode", ("encoding_wrapper",)), ("reassemble", ("payload_splitting",)), ("casefold", ())))

SIGNALS = (
    Countermeasure("structure.zero_width", 0.55, ("homoglyph",)),
    Countermeasure("structure.script_mixing", 0.55, ("homoglyph",)),
    Countermeasure("structure.encoded_blob", 0.30, ("encoding_wrapper",)),
    Countermeasure("structure.expansion", 0.45, ("encoding_wrapper", "payload_splitting")),
    Countermeasure("structure.imperative", 0.25, ()),
    Countermeasure("structure.directive", 0.30, ()),
    Countermeasure("structure.context_reference", 0.30, ("exfiltration",)),
)

LAYERS = {"rule": RULES, "stage": STAGES, "signal": SIGNALS}


def java_regex(pattern: str) -> str:
    """A pattern for Spark: case-blind, line-anchored, Unicode; word characters are letters, digits and underscore."""
    word = r"[\p{L}\p{N}_]"
    edge = rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return "(?imdU)" + pattern.replace(r"\w", word).replace(r"\b", edge)


def plain_regex(pattern: str) -> str:
    """The same pattern for engines whose classes are ASCII."""
    return "(?im)" + pattern


def disabled_for(layer: str, family: str | None) -> frozenset[str]:
    """What a fold that holds out family must not use in a layer; nothing for no family."""
    return frozenset(c.name for c in LAYERS[layer] if family in c.motivated_by)


def coverage(layer: str = "rule") -> dict[str, list[str]]:
    """The countermeasures of a layer that each family motivated, in table order; families by name."""
    return {family: [c.name for c in LAYERS[layer] if family in c.motivated_by] for family in sorted(FAMILIES)}


def countermeasures(spark: SparkSession) -> DataFrame:
    """(layer, name, pos, weight, motivated_by): the registry as a table, a row per countermeasure."""
    rows = [(layer, c.name, i, c.weight, list(c.motivated_by)) for layer, known in LAYERS.items() for i, c in enumerate(known)]
    return spark.createDataFrame(rows, "layer string, name string, pos int, weight double, motivated_by array<string>")
