"""Brand names in their search order, and the aliases of some of them."""

from __future__ import annotations

# --- fixed values: search order decides which brand wins ---
BRANDS = [
    "Creed", "Dior", "Chanel", "Tom Ford", "Maison Francis Kurkdjian", "MFK",
    "Byredo", "Amouage", "Xerjoff", "Le Labo", "Guerlain", "YSL",
    "Armani", "Parfums de Marly", "PDM",
    "Acqua di Parma", "Afnan", "Al Haramain Perfumes", "Al-Rehab", "Ariana Grande",
    "Armaf", "Avon", "Azzaro",
    "BDK Parfums", "BORNTOSTANDOUT®", "Bath & Body Works", "Bond No 9",
    "Britney Spears", "Burberry", "Bvlgari",
    "By Kilian", "Cacharel", "Calvin Klein", "Carolina Herrera", "Chopard",
    "Christian Dior", "Clive Christian",
    "Coach", "Davidoff", "Diptyque", "Dolce & Gabbana", "Dunhill", "Elie Saab",
    "Elizabeth Arden", "Estée Lauder",
    "Fendi", "Ferrari", "Giorgio Armani", "Givenchy", "Gucci", "Hermès", "Hugo Boss",
    "Jean Paul Gaultier",
    "Jimmy Choo", "Jo Malone London", "Jo Malone", "Juicy Couture", "Kenzo", "Kilian",
    "Lacoste", "Lancôme", "Loewe", "Louis Vuitton",
    "Mancera", "Mugler", "Montale", "Nina Ricci", "Nishane", "Oud Al Qasr",
    "Penhaligon's",
    "Perry Ellis", "Prada", "Ralph Lauren", "Rochas", "Salvatore Ferragamo",
    "Serge Lutens", "Valentino",
    "Viktor & Rolf", "Yves Saint Laurent", "Zara", "Lattafa", "Frederic Malle", "MM",
    "Initio",
]
# The line filter knows two more spellings.
LINE_BRANDS = [b for b in BRANDS if b != "Yves Saint Laurent"] + ["Aaron Terence Hughes", "ATH"]
ALIASES = [
    ("MFK", "Maison Francis Kurkdjian"),
    ("Maison Francis Kurkdjian", "Maison Francis Kurkdjian"),
    ("PDM", "Parfums de Marly"),
    ("Parfums de Marly", "Parfums de Marly"),
    ("YSL", "Yves Saint Laurent"),
    ("Yves Saint Laurent", "Yves Saint Laurent"),
    ("ATH", "Aaron Terence Hughes"),
    ("Aaron Terence Hughes", "Aaron Terence Hughes"),
]
# --- end of fixed values ---


def brand_dim(aliases=ALIASES, brands=LINE_BRANDS) -> list[tuple[int, str, str]]:
    """Rows ``(ord, alias, canonical)``: aliases first, then each brand as itself."""
    known = {alias for alias, _ in aliases}
    rows = list(aliases) + [(b, b) for b in brands if b not in known]
    return [(i, alias, canonical) for i, (alias, canonical) in enumerate(rows)]
