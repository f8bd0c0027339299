"""Texts of incidents for the agent and the user (P21), as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: signal -> (to the agent, to the user); %s is the target.
TEXTS = {
    "debug_loop": ("%s keeps changing while its tests keep failing. Read the failing test before the next edit.", "%s is being edited again and again without its tests turning green."),
    "stuck_region": ("%s takes a new form with every edit. Decide on one design, then edit.", "Work on %s does not settle."),
    "token_waste": ("%s has had very many versions and earlier warnings. Stop and ask.", "Much effort goes into %s without progress."),
    "define_loop": ("%s is back at a form it had before. Find what made you leave it.", "%s goes back and forth between the same forms."),
    "boundary_breach": ("%s lies outside the project. Undo the change.", "A file outside the project was changed: %s."),
    "task_scope_breach": ("%s is not part of the task. Undo the change or ask.", "A file outside the task's scope was changed: %s."),
    "regression": ("%s passed before the last changes and fails now.", "A test that passed before fails now: %s."),
    "test_tampering": ("%s turned green by an edit of the test alone. Restore the test.", "A failing test was edited until it passed: %s."),
    "dangling_reference": ("%s calls something that does not exist.", "A call to something unknown remains: %s."),
    "parse_skipped": ("%s cannot be parsed; its changes are not tracked.", "A file cannot be parsed: %s."),
}


def message(signal: Column, target: Column, channel: Column) -> Column:
    out = F.concat(signal, F.lit(": "), target)
    for name, (agent, user) in TEXTS.items():
        told = F.when(channel == "user", F.replace(F.lit(user), F.lit("%s"), target)).otherwise(F.replace(F.lit(agent), F.lit("%s"), target))
        out = F.when(signal == name, told).otherwise(out)
    return out


def full_message(signal: Column, target: Column, channel: Column, details: Column) -> Column:
    """The sentence, then what the incident's JSON details hold: how many rounds, failing cases, suspects, the call that
    leads nowhere. Details that are absent or malformed say nothing."""
    field = lambda name, kind: F.try_variant_get(F.try_parse_json(details), f"$.{name}", kind)
    names = lambda name: F.from_json(F.to_json(field(name, "variant")), "array<string>")
    part = lambda text, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"\n{text}: "), value)).otherwise("")
    rounds, callee = field("rounds", "string"), field("callee_text", "string")
    return F.concat(message(signal, target, channel), part("Rounds", rounds), part("Failing", listed(names("test_cases"), 3)), part("Look at", listed(names("suspects"), 3)), part("Unknown call", callee))


def listed(names: Column, shown: int) -> Column:
    """the first names, comma-joined, and how many more there are."""
    more = F.size(names) - shown
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def days_ago(day: Column, today: Column) -> Column:
    """today, yesterday, N days ago up to a week, else the date."""
    n = F.datediff(today, day)
    return F.when(n == 0, "today").when(n == 1, "yesterday").when(n <= 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
