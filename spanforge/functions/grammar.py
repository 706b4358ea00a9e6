"""Line grammars: the text of a log line as a typed event.

Rules are tried in order and the first match wins; chat comes first, since quoted text can look like anything.  They
run over Arrow batches, a column at a time: a family's test (one scan for its key words) picks the lines that its rules
can match, a rule's pattern is matched on what is left of them, and one extraction of the matching lines gives all
groups, from which the rule's fields are computed by Arrow's own functions.  Nothing is evaluated a line at a time but
texts that repeat (modifier phrases, sums of coins), once for each distinct one.

In Spark's expressions the same rules are some 60 patterns in one CASE and an extraction for each group of each: 44,000
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import segments
from ..sources.lines import scanned
from .schema import FIELDS, MODIFIERS

#: Melee verbs, bare form to third person.
VERBS = {
    "backstab": "backstabs", "bash": "bashes", "bite": "bites", "claw": "claws", "cleave": "cleaves", "crush": "crushes", "frenzy": "frenzies", "gore": "gores", "hit": "hits",
    "kick": "kicks", "learn": "learns", "maul": "mauls", "pierce": "pierces", "punch": "punches", "reave": "reaves", "rend": "rends", "shoot": "shoots", "slam": "slams",
    "slash": "slashes", "slice": "slices", "smash": "smashes", "smite": "smites", "stab": "stabs", "sting": "stings", "strike": "strikes", "sweep": "sweeps",
}
#: Schools of spell damage.
SCHOOLS = ("chromatic", "cold", "corruption", "disease", "fire", "magic", "non-melee", "physical", "poison", "prismatic", "unresistable")
#: Modifier phrases; those of several words come first and take their words with them.
PHRASES = (
    ("Double Bow Shot", "DoubleBowShot"), ("Finishing Blow", "FinishingBlow"), ("Slay Undead", "SlayUndead"), ("Wild Rampage", "WildRampage"), ("Crippling Blow", "Critical"), ("Deadly Strike", "Critical"),
    ("Critical", "Critical"), ("Lucky", "Lucky"), ("Twincast", "Twincast"), ("Flurry", "Flurry"), ("Riposte", "Riposte"), ("Strikethrough", "Strikethrough"), ("Rampage", "Rampage"), ("Assassinate", "Assassinate"),
    ("Headshot", "Headshot"), ("Locked", "Locked"),
)
#: Attitudes of considered targets by the words that tell them.
ATTITUDES = (
    (" scowls at you, ready to attack", "scowl"), (" glares at you threateningly", "threatening"), (" glowers at you dubiously", "dubious"), (" regards you indifferently", "indifferent"),
    (" judges you amiably", "amiable"), (" kindly considers you", "kindly"), (" looks upon you warmly", "warm"), (" regards you as an ally", "ally"),
)
#: Copper in each coin.
COINS = {"platinum": 1000, "gold": 100, "silver": 10, "copper": 1}


Text = pa.Array


def lower_in(c: Text, *values: str) -> pa.Array:
    return pc.is_in(pc.utf8_lower(c), pa.array(values))


def filled(c: Text) -> pa.Array:
    """c with null for the empty text."""
    return pc.if_else(pc.equal(c, ""), None, c)


def capital(c: Text) -> Text:
    return pc.binary_join_element_wise(pc.utf8_upper(pc.utf8_slice_codeunits(c, 0, 1)), pc.utf8_slice_codeunits(c, 1), "")


def both(a: Text, b: Text) -> Text:
    """The group of two that took part in the match."""
    return pc.binary_join_element_wise(a, b, "")


def person(c: Text, owner: Text) -> Text:
    """A name as events carry it: the owner for You and your, a capital first letter for others, null for nothing."""
    return pc.if_else(lower_in(c, "you", "your", "yourself"), owner, filled(capital(c)))


def local_name(c: Text) -> Text:
    """The part after the last dot of a cross-server name."""
    return pc.replace_substring_regex(c, r"^.*\.([^.]+)$", r"\1")


def mapped(c: Text, f: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """f of each distinct text of c."""
    names = c.dictionary_encode()
    return pa.array([f(x) for x in names.dictionary.to_pylist()], kind).take(names.indices)


@lru_cache(4096)
def modifiers(text: str) -> int:
    """Bits of the phrases in text; Riposte counts for nothing beside Strikethrough, unknown words likewise."""
    bits, rest = 0, text
    for phrase, name in PHRASES:
        if re.search(rf"\b{phrase}\b", rest):
            bits |= MODIFIERS[name]
            if " " in phrase:
                rest = re.sub(rf"\b{phrase}\b", " ", rest)
    return bits & ~MODIFIERS["Riposte"] if bits & MODIFIERS["Strikethrough"] else bits


@lru_cache(4096)
def spell_of_trail(text: str) -> str | None:
    """A trailing remark that isn't made of modifiers alone is a spell's name."""
    rest = text
    for phrase, _ in PHRASES:
        rest = re.sub(rf"\b{phrase}\b", "", rest)
    return text if rest.strip() else None


COIN = rf"(\d+) ({'|'.join(COINS)})"


@lru_cache(4096)
def coins(text: str) -> int | None:
    """Copper of texts like "1 platinum, 2 gold and 3 silver"; null for anything else."""
    if not re.fullmatch(rf"{COIN}(?:(?:, | and | ){COIN})*", text.strip()):
        return None
    return sum(int(n) * COINS[name] for n, name in re.findall(COIN, text))


def number(c: Text) -> pa.Array:
    """Digits as a number, null for nothing; what no event can hold becomes too large a number."""
    return filled(pc.if_else(pc.greater(pc.utf8_length(c), 18), "999999999999999999", c)).cast(pa.int64())


def small(c: Text) -> pa.Array:
    n = number(c)
    return pc.if_else(pc.less(n, 1 << 31), n, None)


def decimal(c: Text) -> pa.Array:
    return pc.if_else(pc.match_substring_regex(c, r"^\d+(\.\d*)?$"), c, None).cast(pa.float64())


def choice(c: Text, pairs: tuple) -> Text:
    """The name of the phrase that c is."""
    table = dict(pairs)
    return mapped(c, table.get, pa.string())


@dataclass
class Match:
    """What a rule's fields are computed from: groups of the match, and columns of the matching lines."""

    groups: pa.StructArray
    columns: dict[str, pa.Array]

    def __call__(self, i: int) -> Text:
        return self.groups.field(i - 1)

    def __getattr__(self, name: str) -> pa.Array:
        return self.columns[name]

    def who(self, i: int) -> Text:
        return person(self(i), self.owner)


Make = Callable[[Match], object]


def group_names(pattern: str) -> str:
    """pattern with a name for each capturing group."""
    n = 0

    def named(m: re.Match) -> str:
        nonlocal n
        if m[0] != "(":
            return m[0]
        n += 1
        return f"(?P<g{n}>"

    return re.sub(r"\\.|\[\^?\]?[^\]]*\]|\((?!\?)", named, pattern)


@dataclass
class Rule:
    """pattern is matched on the line (or on its body without trailer), where it holds need; fields are made of the match."""

    kind: str | None
    pattern: str
    fields: dict[str, Make] = field(default_factory=dict)
    need: str = ""
    test: Callable[[Text], pa.Array] | None = None
    emu: bool = False
    grouped: str = field(init=False)

    def __post_init__(self):
        named = group_names(self.pattern)
        self.grouped = named if "(?P<" in named else f"(?P<g1>){named}"


@dataclass
class Family:
    """Rules of lines that the pattern test finds; body: they see the line without trailer and owner annotations."""

    test: str
    rules: list[Rule]
    body: bool = False


BARE, SFORM = "|".join(VERBS), "|".join(VERBS.values())
THIRD = {bare: s[0].upper() + s[1:] for bare, s in VERBS.items()} | {s: s[0].upper() + s[1:] for s in VERBS.values()}


def who(i: int) -> Make:
    return lambda m: m.who(i)


def const(value) -> Make:
    return lambda m: value


def word(i: int) -> Make:
    return lambda m: filled(m(i))


def owner(m: Match) -> Text:
    return m.owner


def verb(*groups: int) -> Make:
    def out(m: Match) -> Text:
        text = m(groups[0]) if len(groups) == 1 else both(m(groups[0]), m(groups[1]))
        return mapped(text, THIRD.get, pa.string())

    return out


def either(a: int, b: int) -> Make:
    return lambda m: person(both(m(a), m(b)), m.owner)


def chat(pattern: str, need: str, channel: Make, sender: Make, text: int, **more: Make) -> Rule:
    return Rule("Chat", pattern, {"channel": channel, "actor": sender, "text": lambda m: m(text), **more}, need)


def sender(i: int) -> Make:
    return lambda m: local_name(m(i))


TONGUE = r",?\s+(?:in an unknown tongue,\s*)?'(.*)'$"
SELF_CHANNELS = (("say out of character", "ooc"), ("say to your guild", "guild"), ("say to your fellowship", "fellowship"), ("say to your party", "group"), ("say", "say"), ("auction", "auction"), ("shout", "shout"), ("tell your party", "group"), ("tell your raid", "raid"), ("tell your group", "group"))
OTHER_CHANNELS = (("says out of character", "ooc"), ("says to your guild", "guild"), ("says", "say"), ("auctions", "auction"), ("shouts", "shout"), ("tells the group", "group"), ("tells the guild", "guild"), ("tells the raid", "raid"), ("tells the fellowship", "fellowship"), ("tells you", "tell"), ("told you", "tell"))

CHAT = [
    chat(rf"^You ({'|'.join(p for p, _ in SELF_CHANNELS)}){TONGUE}", "You ", lambda m: choice(m(1), SELF_CHANNELS), owner, 2),
    chat(rf"^You told ([^\s,]+){TONGUE}", "You told ", const("tell"), owner, 2, target=sender(1)),
    chat(rf"^You tell ([^\s,:]+)(?::\d+)?{TONGUE}", "You tell ", const("custom"), owner, 2, custom_channel=lambda m: pc.utf8_lower(m(1))),
    chat(rf"^(.+?) tells ([^\s,]+):\d+{TONGUE}", " tells ", const("custom"), sender(1), 3, custom_channel=lambda m: pc.utf8_lower(m(2))),
    chat(rf"^(.+?) ({'|'.join(p for p, _ in OTHER_CHANNELS)}){TONGUE}", "", lambda m: choice(m(2), OTHER_CHANNELS), sender(1), 3, target=lambda m: pc.if_else(pc.is_in(m(2), pa.array(["tells you", "told you"])), m.owner, None)),
    chat(r"^(\w+) -> (\w+):\s?(.*)$", " -> ", const("tell"), sender(1), 3, target=word(2)),
]


def hit(kind: str, **more: Make) -> dict[str, Make]:
    return {"damage_kind": const(kind), "modifiers": lambda m: m.mods, "is_spell": const(False), "actor_owner": lambda m: m.actor_owner, "target_owner": lambda m: m.target_owner, **more}


OUTCOMES = (("dodge", "Dodge"), ("parr", "Parry"), ("block", "Block"), ("INVULNERABLE", "Invulnerable"), ("absorbs the blow", "Absorb"), ("miss", "Miss"))


def outcome(i: int) -> Make:
    return lambda m: mapped(m(i), lambda x: next((kind for text, kind in OUTCOMES if text in x), None), pa.string())


def trail_spell(m: Match) -> Text:
    return m.trail_spell


def by_server(live: int, emu: int) -> Make:
    return lambda m: m(emu if m.emu else live)


DAMAGE = [
    Rule("_Critical", r"^(.+?) (?:scores a critical hit!|lands a Crippling Blow!)", {"actor": lambda m: capital(m(1))}, "!", emu=True),
    Rule(None, r"^.+ (?:try|tries) to \w+(?: on)? .+, but .*riposte", need=", but "),
    Rule("Damage", rf"^(?:(You) try|(.+?) tries) to ({BARE})(?: on)? (.+?), but (.+)$", hit("Miss", damage_kind=outcome(5), actor=either(1, 2), target=who(4), sub_type=verb(3), amount=const(0)), ", but ", test=lambda c: pc.match_substring_regex(c, "dodge|parr|block|INVULNERABLE|absorbs the blow|miss")),
    Rule("Damage", r"^(?:The )?.*[Ss]pellshield absorbed (\d+) of (\d+) points of damage", hit("Absorb", target=owner, amount=const(0)), "absorbed"),
    Rule("Damage", r"^(.+?) has shielded .*from .*points of damage", hit("Absorb", target=who(1), amount=const(0)), " has shielded "),
    Rule("Damage", r"^(?:(YOUR)|(.+?)['`]s) (?:magical )?skin absorbs the (?:blow|damage)(?: of (.+?)['`]s .+)?", hit("Absorb", target=either(1, 2), actor=who(3), amount=const(0)), "skin absorbs"),
    Rule("Damage", r"^(?:(.+?) has|.*?(You) have) taken (\d+) points of damage", hit("DamageOverTime", target=either(1, 2), amount=lambda m: number(m(3))), " taken "),
    Rule("Damage", r"^(?:(.+?) has|.*?(You) have) taken (\d+) damage from your (.+?)\.?$", hit("DamageOverTime", target=either(1, 2), actor=owner, amount=lambda m: number(m(3)), sub_type=word(4), spell=word(4)), " taken "),
    Rule("Damage", r"^(?:(.+?) has|.*?(You) have) taken (\d+) damage from (.+) by (.*?)\.?$", hit("DamageOverTime", target=either(1, 2), actor=lambda m: person(pc.utf8_trim_whitespace(by_server(5, 4)(m)), m.owner), amount=lambda m: number(m(3)), sub_type=by_server(4, 5), spell=by_server(4, 5)), " taken "),
    Rule("Damage", r"^(?:(.+?) has|.*?(You) have) taken (\d+) damage from (.+?)\.?$", hit("Other", target=either(1, 2), actor=who(4), amount=lambda m: number(m(3)), sub_type=word(4)), " taken "),
    Rule("Damage", r"^(?:(.+?) has|.*?(You) have) taken (\d+) damage by (.+?)\.?$", hit("Other", target=either(1, 2), actor=who(4), amount=lambda m: number(m(3)), sub_type=word(4), is_spell=const(True)), " taken "),
    Rule("Damage", r"^(.+?) (?:was|were|has been|have been) hit by non-melee for (\d+)(?: points? of)? damage", hit("DirectDamage", target=who(1), amount=lambda m: number(m(2))), " by non-melee "),
    Rule("Damage", rf"^(.+?) hit (.+) for (\d+) points? of ({'|'.join(SCHOOLS)}) damage by (.+?)\.?$", hit("DirectDamage", actor=who(1), target=who(2), amount=lambda m: number(m(3)), school=word(4), sub_type=word(5), spell=word(5)), " hit "),
    Rule("Damage", r"^(.+?) (?:is|are|was|were) .+? by (?:(YOUR)|(.+?)['`]s) .+ for (\d+) points? of non-melee damage[.!]?$", hit("DamageShield", target=who(1), actor=either(2, 3), amount=lambda m: number(m(4))), "non-melee"),
    Rule("Damage", r"^(.+?) (?:is|are|was|were) .+ for (\d+) points? of non-melee damage[.!]?$", hit("DamageShield", target=who(1), amount=lambda m: number(m(2))), "non-melee"),
    Rule("Damage", r"^(.+?) hit (.+) for (\d+) points? of non-melee damage\.?$", hit("DirectDamage", actor=who(1), target=who(2), amount=lambda m: number(m(3)), sub_type=trail_spell, spell=trail_spell), "non-melee"),
    Rule("Damage", rf"^(?:(You) ({BARE})|(.+?) ({SFORM}))(?: on)? (.+?) for (\d+) points? of damage\.?$", hit("Melee", actor=either(1, 3), sub_type=verb(2, 4), target=who(5), amount=lambda m: number(m(6))), " for "),
]

SELVES = ("himself", "herself", "itself", "themself", "themselves", "yourself")


def healed(healer: int, target: int) -> Make:
    return lambda m: pc.if_else(pc.is_in(m(target), pa.array(SELVES)), m.who(healer), m.who(target))


def heal(target: Make, landed: int, actor: Make | None = None) -> dict[str, Make]:
    out = {
        "target": target, "amount": lambda m: number(m(landed)), "potential": lambda m: pc.coalesce(number(m(landed + 1)), number(m(landed))), "over_time": lambda m: pc.not_equal(m(landed - 1), ""),
        "spell": lambda m: pc.coalesce(filled(m(landed + 2)), m.trail_spell), "modifiers": lambda m: m.mods, "actor_owner": lambda m: m.actor_owner,
    }
    return out | ({"actor": actor} if actor else {})


AMOUNT = r"( over time)? for (\d+)(?: \((\d+)\))? (?:hit points|points of damage)(?: by (.+?))?\.?$"
HEAL = [
    Rule("Heal", rf"^(.+?) ha(?:s|ve) been healed{AMOUNT}", heal(who(1), 3), " been healed"),
    Rule("Heal", rf"^(?:.+(?:[!.]|fulfilled) )?(.+?)(?: has)? healed (.+?){AMOUNT}", heal(healed(1, 2), 4, who(1)), " healed "),
]

DEATH = [
    Rule("Death", r"^(You) have slain (.+)!$", {"target": who(2), "actor": who(1)}, "You have slain "),
    Rule("Death", r"^(You) have been slain by (.+)!$", {"target": who(1), "actor": who(2)}, "You have been slain "),
    Rule("Death", r"^(.+?) (?:has been|was) slain by (.+)!$", {"target": who(1), "actor": who(2)}, " slain by "),
    Rule("Death", r"^(.+) died\.$", {"target": who(1)}, " died."),
]


def cast(kind: str, actor: Make, spell: Make | None = None, song: Make = const(False)) -> dict[str, Make]:
    return {"actor": actor, "cast_kind": const(kind), "song": song} | ({"spell": spell} if spell else {})


CAST = [
    Rule("Cast", r"^(.+?) begins? (casting|singing) (.+)\.$", cast("Begin", who(1), word(3), lambda m: pc.equal(m(2), "singing")), " begin"),
    Rule("Cast", r"^(.+?) begins? to (cast a spell|sing a song)\.\s*(?:<?)(.*?)(?:>?)$", cast("Begin", who(1), word(3), lambda m: pc.equal(m(2), "sing a song")), " begin"),
    Rule("Cast", r"^Your (.+) spell is interrupted\.$", cast("Interrupted", owner, word(1)), " interrupted"),
    Rule("Cast", r"^(.+?)(?:['`]s) (.+) spell is interrupted\.$", cast("Interrupted", who(1), word(2)), " interrupted"),
    Rule("Cast", r"^(?:(Your)|(.+?)['`]s) (?:casting|spell) is interrupted[!.]$", cast("Interrupted", either(1, 2)), " interrupted"),
    Rule("Cast", r"^(?:(Your)|(.+?)['`]s)(?: (.+))? spell fizzles!$", cast("Fizzle", either(1, 2), word(3)), " fizzles!"),
    Rule("WearOff", r"^Your (.+) spell has worn off(?: of (.+))?\.$", {"spell": word(1), "target": lambda m: pc.coalesce(m.who(2), m.owner)}, " worn off"),
    Rule("Ability", r"^(.+?) activates? (.+)\.$", {"actor": who(1), "ability": word(2)}, " activate"),
]

STANCE = [
    Rule("Stance", r"^(You|\w+) (?:assumes?|adopts?|enters?|begins? fighting in|takes?|switch(?:es)? to) (?:an?|the|your) (.{1,32}?) (stance|fighting style)\.$", {"actor": who(1), "stance": word(2)}, test=lambda c: pc.invert(pc.match_substring(c, "change your stance"))),
]


def copper(i: int) -> Make:
    return lambda m: mapped(m(i), coins, pa.int64())


def paid(pattern: str) -> Callable[[Text], pa.Array]:
    """Whether the first group of pattern is a sum of coins."""
    return lambda c: pc.is_valid(mapped(pc.extract_regex(c, group_names(pattern)).field(0).fill_null(""), coins, pa.int64()))


def quantity(i: int) -> Make:
    return lambda m: pc.coalesce(small(m(i)), pa.scalar(1, pa.int64()))


def signed_small(i: int) -> Make:
    return lambda m: pc.if_else(pc.less_equal(pc.utf8_length(m(i)), 10), m(i), None).cast(pa.int64())


MISC = [
    Rule("Taunt", r"^(You|.+?) (?:has captured|captures?|capture) (.+?)['`]s attention!$", {"actor": who(1), "target": who(2), "success": const(True), "improved": const(False)}, " attention!"),
    Rule("Taunt", r"^(You|.+?) (?:has |have )?failed to taunt (.+)\.$", {"actor": who(1), "target": who(2), "success": const(False), "improved": const(False)}, " failed to taunt "),
    Rule("Taunt", r"^(.+) is focused on attacking (.+) due to an improved taunt\.$", {"actor": who(2), "target": who(1), "success": const(True), "improved": const(True)}, " improved taunt."),
    Rule("Zone", r"^LOADING, PLEASE WAIT\.\.\.$", {"welcome": const(False)}, "LOADING"),
    Rule("Zone", r"^Welcome to EverQuest!$", {"welcome": const(True)}, "Welcome to "),
    Rule("Zone", r"^You have entered (.+)\.$", {"zone": word(1), "welcome": const(False)}, "You have entered ", test=lambda c: pc.invert(pc.match_substring(c, "You have entered an area where"))),
    Rule("Resist", r"^Your target resisted the (.+) spell\.$", {"actor": owner, "spell": word(1)}, " resisted "),
    Rule("Resist", r"^(.+) resisted your (.+)!$", {"actor": owner, "target": who(1), "spell": word(2)}, " resisted "),
    Rule("Resist", r"^You resist (?:the )?(.+) spell!$", {"target": owner, "spell": word(1)}, "You resist "),
    Rule("Level", r"^You have gained a level! Welcome to level (\d+)!$", {"level": lambda m: small(m(1)), "actor": owner}, " gained a level!"),
    Rule("Experience", r"^You gain (party |raid )?experience!+(?: \(([\d.]+)%\))?$", {"actor": owner, "party": lambda m: pc.not_equal(m(1), ""), "percent": lambda m: decimal(m(2)), "aa_point": const(False)}, " experience!"),
    Rule("Experience", r"^You have gained an ability point!(?:\s+You now have (\d+) ability points?\.)?$", {"actor": owner, "party": const(False), "aa_point": const(True), "aa_total": lambda m: small(m(1))}, " ability point!"),
    Rule("Faction", r"^Your faction standing with (.+) has been adjusted by (-?\d+)\.$", {"faction": word(1), "delta": signed_small(2), "better": lambda m: pc.invert(pc.starts_with(m(2), "-")), "capped": const(False)}, "Your faction standing "),
    Rule("Faction", r"^Your faction standing with (.+) (got better|got worse|could not possibly get any better|could not possibly get any worse)\.$", {"faction": word(1), "better": lambda m: pc.ends_with(m(2), "better"), "capped": lambda m: pc.starts_with(m(2), "could")}, "Your faction standing "),
    Rule("Loot", r"^--(You|.+?) ha(?:ve|s) looted (?:an?|(\d+)) (.+) from (.+?)['`]s corpse\.--$", {"actor": who(1), "item": word(3), "source": word(4), "quantity": quantity(2)}, " looted "),
    Rule("Loot", r"^You looted (?:an?|(\d+)) (.+) from (.+?)['`]s corpse and sold it for (.+?)\.$", {"actor": owner, "item": word(2), "source": word(3), "quantity": quantity(1), "copper": copper(4)}, " looted "),
    Rule("Loot", r"^You receive (.+?) (?:from the (corpse)|as your (split))\.$", {"actor": owner, "source": lambda m: both(m(2), m(3)), "quantity": const(1), "copper": copper(1)}, "You receive ", test=paid(r"^You receive (.+?) (?:from|as) ")),
    Rule("Merchant", r"^You receive (.+?) from (.+) for the (.+?)(?:\(s\))?\.$", {"actor": owner, "target": word(2), "item": word(3), "quantity": const(1), "copper": copper(1), "sold": const(True)}, "You receive ", test=paid(r"^You receive (.+?) from ")),
    Rule("Merchant", r"^You purchased (\d+) (.+) from (.+) for\s+(.+?)\.$", {"actor": owner, "quantity": quantity(1), "item": word(2), "target": word(3), "copper": copper(4), "sold": const(False)}, "You purchased "),
    Rule("Consider", rf"^(.+?)({'|'.join(p for p, _ in ATTITUDES)})(?:.*\(Lvl: (\d+)\)$)?", {"target": word(1), "attitude": lambda m: choice(m(2), ATTITUDES), "level": lambda m: small(m(3))}, "you"),
    Rule("Membership", r"^(You|\w+) (?:has|have) (joined|left) the (raid|group)\.$", {"actor": who(1), "joined": lambda m: pc.equal(m(2), "joined"), "raid": lambda m: pc.equal(m(3), "raid")}, " the "),
    Rule("Membership", r"^(You|\w+) (?:is|are) now the leader of your raid\.$", {"actor": who(1), "joined": const(True), "raid": const(True)}, " now the leader "),
    Rule("Who", r"^\[(?:ANONYMOUS|(\d+) ([^\]]+))\] ([A-Z][a-zA-Z]{2,})\b", {"actor": word(3), "level": lambda m: small(m(1)), "class_text": word(2)}, "["),
]

FAMILIES = [
    Family(r"'$| -> ", CHAT),
    Family(r" damage|, but |skin absorbs|critical hit!|Crippling Blow!", DAMAGE, body=True),
    Family(r" healed ", HEAL, body=True),
    Family(r" slain | died\.$", DEATH),
    Family(r" begins? | interrupted| fizzles!| worn off| activates? ", CAST),
    Family(r" stance\.$| fighting style\.$", STANCE),
    Family("", MISC),
]
#: Names of annotated owners stand before the verb for the actor and after it for the target.
VERB_AHEAD = r" (?:hit|hits|tries|try|has|have|was|were|is|are|healed|SFORM) ".replace("SFORM", SFORM)


def extracted(c: Text, pattern: str) -> Text:
    """The first group of pattern in c, empty where it doesn't match."""
    return pc.extract_regex(c, group_names(pattern)).field(0).fill_null("")


def bodies(line: Text) -> dict[str, pa.Array]:
    """Lines without trailing remark and owner annotations, and what those say."""
    trail = extracted(line, r" \(([^()]*)\)\.?$")
    trail = pc.if_else(pc.match_substring_regex(trail, r"^(?:Owner: |Lvl: |\d)"), "", trail)
    body = pc.if_else(pc.equal(trail, ""), line, pc.replace_substring_regex(line, r" \([^()]*\)\.?$", ""))
    out = {"mods": mapped(trail, modifiers, pa.int32()), "trail_spell": mapped(trail, spell_of_trail, pa.string())}
    owned = pc.match_substring(body, "(Owner: ")
    if not pc.any(owned).as_py():
        none = pa.nulls(len(line), pa.string())
        return out | {"body": body, "actor_owner": none, "target_owner": none}
    head = extracted(body, rf"^(.*?)(?:{VERB_AHEAD})")
    before, after = extracted(head, r" \(Owner: ([^)]+)\)"), extracted(body, rf"(?:{VERB_AHEAD}).*\(Owner: ([^)]+)\)")
    return out | {"body": pc.replace_substring_regex(body, r" \(Owner: [^)]+\)", ""), "actor_owner": filled(before), "target_owner": filled(after)}


#: Arrow types of an event's fields.
TYPES = {name: {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[t] for name, t in FIELDS.items()}


def made(value, kind: pa.DataType, n: int) -> pa.Array:
    if isinstance(value, pa.ChunkedArray):
        value = value.combine_chunks()
    return value.cast(kind) if isinstance(value, pa.Array) else pa.repeat(pa.scalar(value, kind), n)


def matched(line: Text, owners: Text, emu: bool) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Indices of recognised lines, and their kind and fields."""
    found, pieces = [], {name: [] for name in ("kind", *FIELDS)}
    rest = pa.array(range(len(line)), pa.int32())
    for family in FAMILIES:
        if not len(rest):
            break
        text = line.take(rest)
        own = pc.match_substring_regex(text, family.test) if family.test else None
        here, kept = (rest.filter(own), [rest.filter(pc.invert(own))]) if own is not None else (rest, [])
        text = text.filter(own) if own is not None else text
        columns = {"owner": owners.take(here)} | (bodies(text) if family.body else {})
        text = columns.pop("body", text)
        needs: dict[str, pa.Array] = {}
        for rule in family.rules:
            if not len(here):
                break
            if rule.emu and not emu:
                continue
            if rule.need and rule.need not in needs:
                needs[rule.need] = pc.match_substring(text, rule.need)
            met = needs.get(rule.need)
            some = pc.indices_nonzero(met) if met is not None else None
            if some is not None and not len(some):
                continue
            part = text.take(some) if some is not None else text
            hits = pc.match_substring_regex(part, rule.pattern)
            if rule.test:
                hits = pc.and_(hits, rule.test(part))
            at = pc.indices_nonzero(hits)
            if not len(at):
                continue
            at = some.take(at) if some is not None else at
            n = len(at)
            if rule.kind:
                m = Match(pc.extract_regex(text.take(at), rule.grouped), {k: v.take(at) for k, v in columns.items()} | {"emu": emu})
                found.append(here.take(at))
                pieces["kind"].append(pa.repeat(pa.scalar(rule.kind), n))
                for name, kind in TYPES.items():
                    pieces[name].append(made(rule.fields[name](m), kind, n) if name in rule.fields else pa.nulls(n, kind))
            left = pc.invert(pc.is_in(pa.array(range(len(here)), pa.uint64()), at.cast(pa.uint64())))
            here, text = here.filter(left), text.filter(left)
            columns, needs = ({k: v.filter(left) for k, v in x.items()} for x in (columns, needs))
        rest = pa.concat_arrays([*kept, here])
    if not found:
        return pa.array([], pa.int32()), {name: pa.array([], TYPES.get(name, pa.string())) for name in pieces}
    at = pa.concat_arrays(found)
    order = pc.sort_indices(at)
    return at.take(order), {name: pa.concat_arrays(parts).take(order) for name, parts in pieces.items()}


#: Lines that no rule takes, on their way to the spell book.
REST = "_Rest"


def events_schema(lines: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    return f"session_id {kinds['session_id']}, line_no {kinds['line_no']}, ts timestamp_ntz, kind string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def events_batch(head: list[pa.Array], line: Text, owners: Text, emu: bool, rest: bool = False) -> pa.RecordBatch:
    """Events of lines; head has their session_id, line_no and ts.  rest: lines without one are rows of kind REST."""
    at, fields = matched(line, owners, emu)
    if rest:
        other = pc.indices_nonzero(pc.invert(pc.is_in(pa.array(range(len(line)), pa.int32()), at))).cast(pa.int32())
        n = len(other)
        more = {"kind": pa.repeat(pa.scalar(REST), n), "text": line.take(other).cast(pa.string())}
        fields = {name: pa.concat_arrays([c.cast(TYPES.get(name, pa.string())), more[name] if name in more else pa.nulls(n, TYPES[name])]) for name, c in fields.items()}
        at = pa.concat_arrays([at.cast(pa.int32()), other])
    amount = fields["amount"]
    fine = pc.or_kleene(pc.is_null(amount), pc.and_kleene(pc.greater_equal(amount, 0), pc.less_equal(amount, 4294967295)))
    return pa.RecordBatch.from_arrays([*(x.take(at) for x in head), *fields.values()], ["session_id", "line_no", "ts", "kind", *FIELDS]).filter(fine)


def owner_of(lines: DataFrame, owner: Column | None) -> Column:
    return (owner if owner is not None else F.col("owner_name") if "owner_name" in lines.columns else F.lit("You")).cast("string").alias("owner")


def parse(lines: DataFrame, owner: Column | None = None, emu: bool = False, emotes: DataFrame | None = None, owner_name: str = "You") -> DataFrame:
    """Events of lines (session_id, line_no, ts, action), one for each recognised line.

    owner: the log owner's name, by default what session_id's file name says (column owner_name of lines, if there).
    emu: the grammar of emulator servers, whose criticals are announced on a line before the hit.
    emotes: a spell book, in which lines that no rule takes are looked up; what lands on oneself lands on owner_name.
    """
    rest = emotes is not None

    def run(batches):
        for b in batches:
            yield events_batch([b.column(0), b.column(1), b.column(2)], b.column(3), b.column(4), emu, rest)

    picked = lines.where(F.length("action") >= 3).select("session_id", "line_no", "ts", "action", owner_of(lines, owner))
    events = picked.mapInArrow(run, events_schema(picked))
    if rest:
        events = with_emotes(events, emotes, owner_name)
    return announced(events) if emu else events


def parse_text(raw: DataFrame, owner: Column | None = None, emu: bool = False, text: str = "value") -> DataFrame:
    """parse(entries(raw)) in one pass: raw has session_id, line_no and the physical line's text; line_no numbers entries.

    Entries of one physical line follow each other: 4096 numbers are kept for each line.
    """

    def run(batches):
        for b in batches:
            rows, part, ts, action = scanned(b.column(2))
            long = pc.greater_equal(pc.utf8_length(action), 3)
            rows, part, ts, action = (x.filter(long) for x in (rows, part, ts, action))
            number_of = pc.add(pc.multiply(b.column(1).take(rows), 4096), part.cast(pa.int64()))
            yield events_batch([b.column(0).take(rows), number_of, ts], action, b.column(3).take(rows), emu)

    picked = raw.select("session_id", F.col("line_no").cast("long").alias("line_no"), F.col(text).cast("binary").alias("value"), owner_of(raw, owner))
    events = picked.mapInArrow(run, events_schema(picked))
    return announced(events) if emu else events


def with_emotes(events: DataFrame, emotes: DataFrame, owner: str) -> DataFrame:
    """events of which the rows of kind REST became what the spell book (`spells.book`) knows their emotes for, or went."""
    from ..operators import spells

    rest = events.where(F.col("kind") == REST).select("session_id", "line_no", "ts", F.col("text").alias("action"))
    known = spells.recognise(rest, emotes, owner).drop("candidates")
    return events.where(F.col("kind") != REST).unionByName(known, allowMissingColumns=True)


def announced(events: DataFrame) -> DataFrame:
    """events without announcements; the next melee hit of the one announced last is critical.

    What was announced last is carried over stretches of a session, as one log may be the whole table.
    """
    keys, order, call = ["session_id"], ["line_no"], F.col("kind") == "_Critical"
    rows = segments.carried(segments.dealt(events, keys, order), keys, order, _call=("last", F.when(call, F.struct("line_no", "actor"))))
    melee = rows.where((F.col("kind") == "Damage") & (F.col("damage_kind") == "Melee") & (F.col("actor") == F.col("_call.actor")))
    first = melee.groupBy("session_id", F.col("_call.line_no").alias("_from")).agg(F.min("line_no").alias("line_no")).select("session_id", "line_no", F.lit(MODIFIERS["Critical"]).alias("_more"))
    met = rows.where(~call).join(first, [*keys, *order], "left")
    return met.withColumn("modifiers", F.when(F.col("_more").isNull(), F.col("modifiers")).otherwise(F.col("modifiers").bitwiseOR(F.col("_more")))).select(*events.columns)


def instance_zone(c: Column) -> Column:
    """struct(base, difficulty, tier) of zone names like "Base 3 (Tier)"."""
    p = r"^(.*?) (\d+) \(([^)]+)\)$"
    inst = c.rlike(p)
    return F.struct(F.when(inst, F.regexp_extract(c, p, 1)).otherwise(c).alias("base"), F.when(inst, F.regexp_extract(c, p, 2).try_cast("int")).alias("difficulty"), F.when(inst, F.regexp_extract(c, p, 3)).alias("tier"))
