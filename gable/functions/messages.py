"""Whole messages for alerts, price drops and events, in the escaped markup that they are sent in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Heads, symbols and words of the messages, and names of the states of a dwelling.
HEADS = {"top": "🟢 *TOP OPPORTUNITE*", "bon": "🟡 *BON PLAN*"}
STATE_NAMES = {
    "neuf": "Neuf", "tres_bon_etat": "Tres bon etat", "bon_etat": "Bon etat", "correct": "Correct", "a_rafraichir": "A rafraichir",
    "travaux_importants": "Travaux importants", "a_renover": "A renover",
}
UNKNOWN_ADDRESS, UNKNOWN_DISTRICT, NO_ENERGY = "Adresse inconnue", "Quartier inconnu", "N/A"


def _said(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def rate(c: Column) -> Column:
    """`8.2%`, 0 where there is none."""
    return _said(F.format_string("%.1f", text.round_half_even(F.coalesce(c, F.lit(0.0)), 1)), "%")


def rent_line(bare: Column, furnished: Column) -> Column:
    """The range of a rent from bare to furnished, or the bare one, or that there is none."""
    whole = lambda c: F.bround(c).cast("long").cast("string")
    bare, furnished = F.coalesce(bare, F.lit(0.0)), F.coalesce(furnished, F.lit(0.0))
    return (
        F.when((bare != 0) & (furnished != 0) & (bare != furnished), _said("🏠 Loyer potentiel: ", whole(bare), "\\-", whole(furnished), " EUR/mois \\(nu a meuble\\)"))
        .when(bare != 0, _said("🏠 Loyer potentiel: ~", whole(bare), " EUR/mois \\(nu\\)")).otherwise("🏠 Loyer potentiel: non disponible")
    )


def enrichment_lines(found: Column) -> Column:
    """The lines of a model's answer (resume, etat_bien, signaux_nego, equipements, red_flags, info_copro) as one text; null without an answer."""
    state, condo = found["etat_bien"], found["info_copro"]
    names = F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair])
    listed = lambda head, c: F.when(F.size(c) > 0, _said(head, text.escape_markdown(F.array_join(c, ", "))))
    filled = lambda c: F.when(c != 0, c)
    charges = F.coalesce(filled(condo["charges_annuelles_lot"]), filled(condo["charges_annuelles"]))
    lots = F.when(condo["nb_lots"] != 0, _said(", copro ", condo["nb_lots"].cast("string"), " lots")).otherwise("")
    lines = F.concat_ws(
        "\n", F.lit("🤖 *Analyse IA:*"), F.when(found["resume"] != "", text.escape_markdown(found["resume"])),
        F.when((state != "") & (state != "inconnu"), _said("• Etat: ", text.escape_markdown(F.coalesce(F.try_element_at(names, state), state)))),
        listed("• Signaux nego: ", found["signaux_nego"]), listed("• Equipements: ", found["equipements"]), listed("⚠️ Red flags: ", found["red_flags"]),
        _said("• Copro: ", text.escape_markdown(_said(text.float_text(charges), " EUR/an (ce lot)", lots))),
    )
    return F.when(found.isNotNull(), _said("\n", lines))


def _place(address: Column, district: Column) -> Column:
    return _said("📍 ", F.coalesce(address, F.lit(UNKNOWN_ADDRESS)), " \\- ", F.coalesce(district, F.lit(UNKNOWN_DISTRICT)))


def _size(surface: Column, rooms: Column) -> Column:
    return _said("📐 ", text.float_text(surface), "m² \\- T", rooms.cast("string"))


def _link(url: Column) -> Column:
    return _said("🔗 [Voir l'annonce](", F.coalesce(url, F.lit("")), ")")


def alert(
    level: Column, address: Column, district: Column, price: Column, surface: Column, rooms: Column, energy: Column, score: Column, yields: dict[int, Column], bare: Column, furnished: Column, enrichment: Column, url: Column
) -> Column:
    """The message of a top or a good alert (null of other levels). yields: by discount in percent, 0, 5, 10 and 15."""
    price, surface, rooms = F.coalesce(price.cast("double"), F.lit(0.0)), F.coalesce(surface.cast("double"), F.lit(0.0)), F.coalesce(rooms, F.lit(0))
    per = F.when(surface > 0, F.bround(price / surface)).otherwise(F.lit(0.0))
    cut = {5: F.bround(price * 0.95), 10: F.bround(price * 0.90), 15: F.bround(price * 0.85)}
    scenes = [_said(f"• \\-{d}%: ", rate(yields[d]), " \\(", text.money(cut[d]), "\\)") for d in cut]
    body = F.concat_ws(
        "\n", F.lit(""), _place(address, district), _said("💰 ", text.money(price), " \\(", text.money(per), "/m²\\)"), _size(surface, rooms), _said("🏷️ DPE: ", F.coalesce(energy, F.lit(NO_ENERGY))),
        _said("📊 Score: ", text.float_text(score), "/100"), _said("💸 Renta brute: ", rate(yields[0])), rent_line(bare, furnished), F.lit(""), F.lit("Scenarios nego:"), *scenes, enrichment_lines(enrichment), F.lit(""), _link(url),
    )
    head = F.try_element_at(F.create_map(*[F.lit(x) for pair in HEADS.items() for x in pair]), level)
    return _said(head, "\n", body)


def price_drop(address: Column, district: Column, surface: Column, rooms: Column, old: Column, new: Column, url: Column) -> Column:
    """The message of a lower price."""
    old, new = old.cast("double"), new.cast("double")
    share = F.when(old > 0, text.round_half_even((old - new) / old * 100, 1)).otherwise(F.lit(0.0))
    said = F.when(old > 0, text.float_text(share)).otherwise("0")
    return F.concat_ws(
        "\n", F.lit("📉 *BAISSE DE PRIX*"), F.lit(""), _place(address, district), _size(F.coalesce(surface.cast("double"), F.lit(0.0)), F.coalesce(rooms, F.lit(0))), F.lit(""), _said("Ancien prix: ", text.money(old)),
        _said("Nouveau prix: ", text.money(new)), _said("Baisse: \\-", text.money(old - new), " \\(\\-", said, "%\\)"), F.lit(""), _link(url),
    )


def event(name: Column, detail: Column, at: Column) -> Column:
    """The message of a technical event."""
    return F.concat_ws("\n", F.lit("⚠️ *ALERTE SYSTEME*"), F.lit(""), _said("*Evenement:* ", name), _said("*Detail:* ", detail), _said("*Date:* ", F.date_format(at, "dd/MM/yyyy HH:mm")))
