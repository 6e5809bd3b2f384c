"""Column names and contents to business fields.

Contents are profiled over the distinct values of the whole table; the scoring of names
runs on the driver, over column names only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmattan.functions.dates import parse_date
from harmattan.functions.nulls import data_columns, stripped
from harmattan.functions.numbers import to_double

CONFIRMED, SUGGESTED, AMBIGUITY_GAP = 88, 72, 6

# Business fields, their family and the labels they go by.
FIELDS = {
    "date": ("date", ["date", "dt", "date vente", "date facture"]),
    "date_commande": ("date", ["date commande", "purchase date", "order date", "datefirstpurchase", "date first purchase"]),
    "date_livraison": ("date", ["date livraison", "delivery date", "ship date"]),
    "date_paiement": ("date", ["date paiement", "payment date"]),
    "date_naissance": ("date", ["date naissance", "birthdate", "birth date", "date de naissance", "dob"]),
    "date_premier_achat": ("date", ["date premier achat", "first purchase date", "datefirstpurchase", "date first purchase"]),
    "montant_total": ("amount", ["montant total", "mont ttc", "total fact", "mnt", "montant ttc", "total amount"]),
    "prix_unitaire": ("amount", ["prix unitaire", "prixunitaire", "pu", "prix unit", "unit price", "unitprice"]),
    "remise": ("amount", ["remise", "discount"]),
    "quantite": ("quantity", ["qte", "qté", "quantite", "qty", "quantity"]),
    "client": ("entity", ["client", "client nom", "nom client", "customer", "customer name", "client_name"]),
    "produit": ("entity", ["produit", "designation", "article", "product", "item"]),
    "reference": ("identifier", ["reference", "ref", "réf", "sku", "product reference", "key", "alternate key", "product key"]),
    "categorie": ("entity", ["categorie", "catégorie", "famille", "category", "subcategory", "sub category", "product category"]),
    "description": ("entity", ["description", "libelle", "label", "name", "display name", "product name", "subcategory name"]),
    "vendeur": ("entity", ["vendeur", "commercial", "agent", "salesperson", "sales rep"]),
    "canal": ("entity", ["canal", "channel", "sales channel"]),
    "region": ("geo", ["region", "zone", "territoire", "country", "province"]),
    "stock_initial": ("quantity", ["stock initial", "opening stock"]),
    "stock_final": ("quantity", ["stock final", "closing stock"]),
    "entrepot": ("geo", ["entrepot", "dépôt", "depot", "warehouse"]),
    "id_commande": ("identifier", ["id commande", "commande id", "num commande", "order id"]),
    "id_facture": ("identifier", ["id facture", "facture id", "num facture", "invoice id"]),
    "id_produit": ("identifier", ["id produit", "produit id", "product id"]),
    "id_client": ("identifier", ["id client", "client id", "customer id"]),
    "telephone": ("phone", ["telephone", "phone", "mobile", "tel", "gsm", "phone number"]),
    "email": ("email", ["email", "mail", "e-mail", "email address"]),
    "prenom": ("person_name", ["prenom", "prénom", "firstname", "first name", "given name"]),
    "nom": ("person_name", ["nom", "lastname", "last name", "surname", "family name"]),
    "civilite": ("title", ["civilite", "civility", "title", "salutation", "mr", "mrs"]),
    "genre": ("gender", ["gender", "genre", "sexe", "sex"]),
}
# Words that settle the field by themselves, in order.
DECISIVE = [
    ("prenom", ["firstname", "first name", "prenom", "prénom", "given name"]),
    ("nom", ["lastname", "last name", "surname", "family name"]),
    ("client", ["client", "customer"]),
    ("telephone", ["phone", "telephone", "tel", "mobile", "gsm"]),
    ("email", ["email", "mail", "e mail"]),
    ("date_premier_achat", ["first purchase", "datefirstpurchase", "premier achat"]),
    ("date_naissance", ["birth", "naissance", "dob", "birthdate"]),
    ("reference", ["reference", "ref", "sku", "alternatekey", "alternate key", "productkey", "product key"]),
    ("categorie", ["category", "categorie", "subcategory", "sub category"]),
    ("description", ["description", "libelle", "label", "display name"]),
    ("nom", ["nom"]),
    ("civilite", ["title", "civilite", "civility", "salutation", "mr", "mrs", "ms", "mme"]),
    ("genre", ["gender", "genre", "sex", "sexe"]),
]
IGNORED = ["suffix", "namestyle", "name style"]
# Label words that pick the field inside a content family, first match wins, else the default.
BY_CONTENT = {
    "date": (
        [("date_commande", ["commande", "order", "purchase"]), ("date_livraison", ["livraison", "delivery", "ship"]), ("date_naissance", ["birth", "naissance", "dob"]), ("date_premier_achat", ["first purchase", "premier achat"])],
        "date",
    ),
    "amount": ([("prix_unitaire", ["unit", "unitaire", "price"])], "montant_total"),
    "person_name": ([("prenom", ["first", "prenom"]), ("nom", ["last", "surname", "nom"])], "client"),
    "quantity": ([], "quantite"),
    "identifier": ([("id_client", ["client"]), ("id_produit", ["product", "produit"]), ("id_facture", ["invoice", "facture"]), ("id_commande", ["commande", "order"])], "reference"),
    "email": ([], "email"),
    "phone": ([], "telephone"),
    "gender": ([], "genre"),
    "title": ([], "civilite"),
}
CONTENT_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone": r"^\+?[0-9][0-9\s().-]{6,}$",
    "gender": r"^(?i)(m|f|male|female|homme|femme|masculin|feminin|féminin)$",
    "title": r"^(?i)(mr|mrs|ms|mme|mlle|m|dr|prof)$",
    "person_name": r"^[A-Za-zÀ-ÿ' -]{2,}$",
}
# Label parts that reveal what a table is about, and the fields this favours.
DOMAINS = [
    ("customer", ["client", "firstname", "lastname", "birthdate", "gender", "phone", "email"], 12,
     {"prenom", "nom", "genre", "civilite", "telephone", "email", "date_naissance", "date_premier_achat", "date_commande", "client"}),
    ("inventory", ["stock", "warehouse", "entrepot"], 10, {"stock_initial", "stock_final", "entrepot", "produit", "reference"}),
    ("sales", ["montant", "prix", "facture", "invoice"], 8,
     {"montant_total", "prix_unitaire", "quantite", "date", "date_commande", "client", "produit"}),
]


@dataclass(frozen=True)
class Match:
    field: str | None
    score: int
    confirmed: bool
    method: str


def label_of(name: str) -> str:
    return re.sub(r"[\W_]+", " ", str(name).strip().lower()).strip()


def _has(label: str, word: str) -> bool:
    word = label_of(word)
    return word in label if " " in word or len(word) >= 4 else word in label.split()


def _alike(left: str, right: str) -> int:
    a, b = (" ".join(sorted(s.split())) for s in (left, right))
    return int(SequenceMatcher(None, a, b).ratio() * 100)


def content_profiles(df: DataFrame) -> dict[str, str | None]:
    """Dominant kind of content per column, in one aggregate over the rows; one row reaches the driver.

    Shares are of the filled cells; the median that tells quantities from amounts is approximate.
    """
    shares = content_shares(df).first()
    return {c: _profile(shares[c]) if shares[c]["filled"] else None for c in data_columns(df)}


def content_shares(df: DataFrame) -> DataFrame:
    """One row with a struct per column: filled cells, the share of each kind of content among them, and the median number."""
    described = []
    for c in data_columns(df):
        text = F.lower(stripped(F.col(c).cast("string")))
        text = F.when(text != "", text)
        number = to_double(F.replace(text, F.lit(" "), F.lit("")))
        date_shape = text.rlike(r"[/.-]|[a-zà-ÿ]{3,}|^\d{8}$")
        tests = {k: text.rlike(p) for k, p in CONTENT_PATTERNS.items()}
        tests |= {"date": date_shape & parse_date(text).isNotNull(), "number": number.isNotNull()}
        filled = F.count(text)
        parts = [F.coalesce(F.count_if(test) / filled, F.lit(0.0)).alias(k) for k, test in tests.items()]
        described.append(F.struct(filled.alias("filled"), *parts, F.percentile_approx(number, 0.5).alias("median")).alias(c))
    return df.agg(*described)


def _profile(share) -> str | None:
    for kind in ("email", "date", "phone", "gender", "title"):
        if share[kind] >= 0.7:
            return kind
    if share["number"] >= 0.7:
        median = share["median"]
        return "quantity" if 0 <= median <= 10000 else "amount" if median > 1000 else "identifier"
    return "person_name" if share["person_name"] >= 0.8 else None


def _conflicts(field: str, family: str, label: str, profile: str | None) -> bool:
    """A field that the label or the content rules out."""
    if profile in ("phone", "email", "gender", "title") and family != profile:
        return True
    decided = next((f for f, words in DECISIVE if any(_has(label, w) for w in words)), None)
    if decided in ("telephone", "email", "genre", "prenom", "civilite", "date_naissance") and field != decided:
        return True
    if any(_has(label, w) for w in ("prix", "unitaire", "unit price")) and family in ("quantity", "date"):
        return True
    if re.search(r"\b(key|id)\b", label) and family in ("quantity", "amount") or re.search(r"\b(key|id)\b", label) and field in ("client", "produit"):
        return True
    return bool(re.search(r"name|label|libelle", label)) and family in ("quantity", "amount")


def _score(field: str, label: str, profile: str | None, domain) -> int:
    family, aliases = FIELDS[field]
    base = max(_alike(label, label_of(a)) for a in [field, *aliases])
    if _conflicts(field, family, label, profile):
        return max(0, base - 70)
    if profile:
        base += 22 if family == profile else -20
    if any(_has(label, w) for w in ("prix", "unit", "unitaire")):
        base += 25 if field == "prix_unitaire" else 0
    if re.search(r"\b(key|id)\b", label) and family == "identifier":
        base += 16
    if domain and field in domain[3]:
        base += domain[2]
    return max(0, min(100, base))


def map_columns(df: DataFrame, profiles: Mapping[str, str | None] | None = None) -> dict[str, Match]:
    """Best business field per column; unmapped ones carry no field."""
    profiles = content_profiles(df) if profiles is None else profiles
    columns = data_columns(df)
    labels = {c: label_of(c) for c in columns}
    joined = " ".join(labels.values())
    domain = next((d for d in DOMAINS if any(w in joined for w in d[1])), None)
    return {c: _match(labels[c], profiles.get(c), domain) for c in columns}


def _match(label: str, profile: str | None, domain) -> Match:
    if any(_has(label, w) for w in IGNORED):
        return Match(None, 0, False, "ignored")
    exact = next((f for f, (_, aliases) in FIELDS.items() if label in [label_of(f), *map(label_of, aliases)]), None)
    decided = exact or next((f for f, words in DECISIVE if any(_has(label, w) for w in words)), None)
    if decided:
        return Match(decided, 100, True, "direct_rule")
    ranked = sorted(((_score(f, label, profile, domain), f) for f in FIELDS), key=lambda x: -x[0])
    (best, field), second = ranked[0], ranked[1][0]
    if profile in BY_CONTENT and best < CONFIRMED:
        choices, default = BY_CONTENT[profile]
        field = next((f for f, words in choices if any(w in label for w in words)), default)
        sure = profile in ("date", "phone", "email", "gender", "title")
        best = max(best, CONFIRMED if sure else SUGGESTED + AMBIGUITY_GAP)
        return Match(field, best, best >= CONFIRMED, "content_matching")
    if best < SUGGESTED or (best < CONFIRMED and best - second < AMBIGUITY_GAP):
        return Match(None, best, False, "to_review")
    return Match(field, best, best >= CONFIRMED, "fuzzy_matching")


def fields_of(matches: Mapping[str, Match]) -> dict[str, str]:
    """Column to field, each field used once (best score first)."""
    taken, out = set(), {}
    for column, m in sorted(matches.items(), key=lambda x: -x[1].score):
        if m.field and m.field not in taken:
            taken.add(m.field)
            out[column] = m.field
    return out
