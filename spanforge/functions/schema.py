"""The event row: one wide record for all kinds of events, and its enumerations."""

from __future__ import annotations

#: Outcomes of damage events; those after Other are avoidances of amount 0.
DAMAGE_KINDS = ("Melee", "DirectDamage", "DamageOverTime", "DamageShield", "Other", "Miss", "Dodge", "Parry", "Block", "Invulnerable", "Absorb")
LANDED = DAMAGE_KINDS[:5]
AVOIDED = DAMAGE_KINDS[5:]

#: Hit modifiers, one bit each.
MODIFIERS = {
    name: 1 << bit
    for bit, name in enumerate(
        ("Critical", "Lucky", "Twincast", "Flurry", "Rampage", "WildRampage", "Riposte", "Strikethrough", "DoubleBowShot", "Assassinate", "Headshot", "FinishingBlow", "SlayUndead", "Locked")
    )
}

#: Columns of an event row after session_id, line_no, ts and kind; a kind fills those it has.
FIELDS = {
    "actor": "string", "target": "string", "amount": "bigint", "potential": "bigint", "damage_kind": "string", "sub_type": "string", "modifiers": "int",
    "school": "string", "is_spell": "boolean", "actor_owner": "string", "target_owner": "string", "spell": "string", "over_time": "boolean", "cast_kind": "string",
    "song": "boolean", "emote": "string", "ability": "string", "stance": "string", "success": "boolean", "improved": "boolean", "channel": "string", "text": "string", "custom_channel": "string",
    "zone": "string", "welcome": "boolean", "raid": "boolean", "joined": "boolean", "level": "int", "class_text": "string", "percent": "double", "party": "boolean",
    "aa_point": "boolean", "aa_total": "int", "faction": "string", "delta": "int", "better": "boolean", "capped": "boolean", "item": "string", "source": "string",
    "copper": "bigint", "quantity": "int", "sold": "boolean", "attitude": "string",
}

EVENT_DDL = "session_id string, line_no bigint, ts timestamp_ntz, kind string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())
KINDS = ("Damage", "Heal", "Death", "Cast", "WearOff", "Landed", "Ability", "Stance", "Taunt", "Chat", "Zone", "Membership", "Who", "Resist", "Experience", "Faction", "Loot", "Merchant", "Consider", "Level")
