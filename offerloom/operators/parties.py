"""Lead managers, registrar and the company office, with contacts found near the names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank_to_null, canon_name, clean_email, clean_name, clean_phone, let, looks_like_party, name_groups, name_token, rx, squeeze
from ..rows import first_by, once
from ..rules import facts as R

EMAIL = r"[\w.+-]+@[\w.-]+\.\w{2,}"
_MENTION = "array<struct<role:string,pos:int,raw:string>>"


def _found(text: Column, role: str, pattern: str) -> Column:
    """Matches of a pattern as (role, pos, raw); positions are sums of the lengths of the pieces between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_MENTION).alias("out"))

    def walked(whole: Column, groups: Column, pieces: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            at = acc["at"] + F.length(F.get(pieces, i))
            one = F.array(F.struct(F.lit(role).alias("role"), at.alias("pos"), F.get(groups, i).alias("raw")))
            return F.struct((at + F.length(F.get(whole, i))).alias("at"), F.concat(acc["out"], one).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), start, step)["out"]

    def met(whole: Column) -> Column:
        groups, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern, -1)
        listed = let(groups, lambda g: let(pieces, lambda p: walked(whole, g, p)))
        return F.when(F.size(whole) > 0, listed).otherwise(F.array().cast(_MENTION))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), met)


def _email_pattern(token: Column) -> Column:
    return F.concat(
        F.lit(r"(?i)([\w.+-]*"), token, F.lit(r"[\w.+-]*@[\w.-]+\.\w{2,}|[\w.+-]+@[\w.-]*"), token, F.lit(r"[\w.-]*\.\w{2,})")
    )


def _extract(text: Column, pattern: Column) -> Column:
    return blank_to_null(F.call_function("regexp_extract", text, pattern, F.lit(1)))


def email_for(text: Column, name: Column) -> Column:
    """First address whose local part or domain holds the name's first long word."""
    return clean_email(_extract(text, _email_pattern(name_token(name))))


def website_for(text: Column, name: Column) -> Column:
    pattern = F.concat(F.lit(r"(?i)(https?://[\w.-]*"), name_token(name), F.lit(r"[\w.-]*\.[^\s<>\"'|]+)"))
    return F.regexp_replace(_extract(text, pattern), r"[\\)\];,.'\"]+$", "")


def _first_phone(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, "(?i)" + R.PHONE, 1))


def _last_phone(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit("(?i)" + R.PHONE), F.lit(1)), F.lit(-1))


def phone_near(text: Column, at: Column, after: int | None = None, before: int | None = None) -> Column:
    """First phone after a 1-based position, else the last one before it; with numbers, within so many characters."""
    tail = F.substr(text, at) if after is None else F.substr(text, at, F.lit(after))
    start = F.lit(1) if before is None else F.greatest(F.lit(1), at - before)
    return clean_phone(F.coalesce(_first_phone(tail), _last_phone(F.substr(text, start, at - start))))


def _mentions(docs: DataFrame, after: int | None, before: int | None) -> DataFrame:
    """doc_id and its plausible mentions with their contacts, in order: one array per document."""
    flat = once(docs, {"_flat": squeeze(F.col("text"))}).select("doc_id", "_flat")
    found = F.concat(*[_found(F.col("_flat"), role, "(?i)" + rx(p)) for role, p in R.PARTY_ROLES.items()])
    raw = once(flat, {"_raw": found}).filter(F.size("_raw") > 0)
    addresses = F.array_distinct(F.transform(F.regexp_extract_all("_flat", F.lit(EMAIL), F.lit(0)), F.lower))
    # An address that is not printed in lower case has no place of its own.
    placed = F.transform(addresses, lambda e: F.struct(
        e.alias("email"), F.position(e, F.col("_flat")).alias("at"), F.substring_index(e, "@", 1).alias("local"),
        F.regexp_replace(F.substring_index(e, "@", -1), r"\.\w{2,}$", "").alias("domain"),
    ))
    named = once(raw, {
        "_named": F.filter(
            F.transform("_raw", lambda m: F.struct(m["role"].alias("role"), m["pos"].alias("pos"), canon_name(m["raw"]).alias("name"))),
            lambda m: looks_like_party(m["name"]),
        ),
        "_mail": placed,
    }).filter(F.size("_named") > 0)

    def contact(m: Column) -> Column:
        def known(token: Column) -> Column:
            best = F.get(F.filter("_mail", lambda e: F.contains(e["local"], token) | F.contains(e["domain"], token)), F.lit(0))
            return let(best, lambda b: F.struct(
                m["role"].alias("role"), m["pos"].alias("pos"), m["name"].alias("name"), b["email"].alias("email"),
                phone_near(F.col("_flat"), F.when(b["at"] > 0, b["at"]).otherwise(m["pos"] + 1), after, before).alias("phone"),
            ))

        return let(name_token(m["name"]), known)

    return once(named, {"mentions": F.transform("_named", contact)}).select("doc_id", "mentions")


def party_mentions(docs: DataFrame, phone_after: int | None = None, phone_before: int | None = None) -> DataFrame:
    """doc_id, role, pos, name, email, phone of every plausible mention. Nothing is shuffled.

    A phone is looked for behind the address or name, then before it; with ``phone_after`` and ``phone_before``
    (the surveyed windows are R.PHONE_AFTER and R.PHONE_BEFORE) within so many characters.
    """
    return _mentions(docs, phone_after, phone_before).select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.*")


def parties_of(docs: DataFrame, threshold: float = 0.9, phone_after: int | None = None, phone_before: int | None = None) -> DataFrame:
    """doc_id, role, name, pos, email, phone, mentions: the parties of each document, within its own row.

    Mentions of one role with similar names become one party; the first name stays and later mentions fill
    missing contacts. Equal to dedupe_parties of party_mentions, without a shuffle.
    """
    held = _mentions(docs, phone_after, phone_before)
    # Greedy clusters go by the order of positions, one list of names per role.
    def of_role(role: str) -> Column:
        own = F.filter("mentions", lambda m: m["role"] == role)
        return F.array_sort(own, lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))

    def folded(mentions: str, heads: str) -> Column:
        tagged = F.arrays_zip(mentions, heads)

        def fold(own: Column) -> Column:
            given = lambda c: F.get(F.filter(F.transform(own, lambda t: t[mentions][c]), lambda v: v.isNotNull()), F.lit(0)).alias(c)
            first = F.get(own, F.lit(0))
            return F.struct(
                first[mentions]["role"].alias("role"), first[heads].alias("name"), first[mentions]["pos"].alias("pos"), given("email"), given("phone"),
                F.size(own).cast("long").alias("mentions"),
            )

        return F.transform(F.array_distinct(heads), lambda head: let(F.filter(tagged, lambda t: t[heads] == head), fold))

    held = once(held, {f"_m{i}": of_role(role) for i, role in enumerate(R.PARTY_ROLES)})
    parts = []
    for i in range(len(R.PARTY_ROLES)):
        held = held.withColumn(f"_h{i}", name_groups(F.transform(f"_m{i}", lambda m: m["name"]), threshold))
        parts.append(folded(f"_m{i}", f"_h{i}"))
    return once(held, {"_parties": F.concat(*parts)}).select("doc_id", F.explode("_parties").alias("p")).select("doc_id", "p.*")


def dedupe_parties(mentions: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Mentions of one document and role with similar names become one party; the first name
    stays and later mentions fill missing contacts."""
    heads = mentions.groupBy("doc_id", "role", "name").agg(F.min("pos").alias("first_pos"))
    lists = heads.groupBy("doc_id", "role").agg(F.array_sort(F.collect_list(F.struct("first_pos", "name"))).alias("l"))
    names = F.transform("l", lambda s: s["name"])
    grouped = lists.withColumn("_names", names).withColumn("_heads", name_groups(F.col("_names"), threshold))
    head_of = grouped.select("doc_id", "role", F.explode(F.arrays_zip("_names", "_heads")).alias("z")).select(
        "doc_id", "role", F.col("z._names").alias("name"), F.col("z._heads").alias("party")
    )
    joined = mentions.join(head_of, ["doc_id", "role", "name"])
    return joined.groupBy("doc_id", "role", F.col("party").alias("name")).agg(
        F.min("pos").alias("pos"),
        first_by(F.col("email"), F.col("pos")).alias("email"),
        first_by(F.col("phone"), F.col("pos")).alias("phone"),
        F.count(F.lit(1)).alias("mentions"),
    )


def pick_registrar(parties: DataFrame) -> DataFrame:
    """One registrar per document: parties with an email first, then the first named."""
    return parties.filter("role = 'registrar'").groupBy("doc_id").agg(
        F.min_by(F.struct("name", "email", "phone"), F.struct(F.col("email").isNull().alias("n"), "pos")).alias("r")
    ).select("doc_id", "r.*")


def company_contacts(docs: DataFrame, office_chars: int | None = None, phone_after: int | None = None, phone_before: int | None = None) -> DataFrame:
    """docs(doc_id, text, company_name) → registered office, contact person, email, phone, website.

    Contacts of the office are read from its heading to the end of the text; with ``office_chars`` (surveyed:
    R.OFFICE_BLOCK) from so many characters, and phones as in party_mentions.
    """
    flat = once(docs, {"flat": squeeze(F.col("text"))}).select("doc_id", "company_name", "flat")
    office_at = F.regexp_instr("flat", F.lit(r"(?i)registered\s+office"))
    office = F.substr(F.col("flat"), office_at) if office_chars is None else F.substr(F.col("flat"), office_at, F.lit(office_chars))
    block = F.when(office_at > 0, office).otherwise(F.col("flat"))
    named = once(flat, {"_at": office_at, "_block": block})
    email = F.coalesce(
        email_for(F.col("flat"), F.col("company_name")),
        blank_to_null(F.regexp_extract("_block", r"(?i)e-?mail(?:\s+id)?\s*:?\s*\[?([\w.+-]+@[\w.-]+\.\w{2,})", 1)),
    )
    site = F.coalesce(
        website_for(F.col("flat"), F.col("company_name")), blank_to_null(F.regexp_extract("_block", r"(?i)(https?://[^\s<>\"'|]+)", 1))
    )
    staged = once(named, {"_email": email, "_site": site})
    at = F.coalesce(F.position(F.col("_email"), F.col("flat")), F.lit(0))
    by_email = F.when(at > 0, phone_near(F.col("flat"), at, phone_after, phone_before)).otherwise(clean_phone(_last_phone(F.col("flat"))))
    by_office = phone_near(F.col("flat"), F.greatest(F.lit(1), F.col("_at")), phone_after, phone_before)
    person = F.regexp_extract("_block", r"(?i)contact\s+person\s*:?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})", 1)
    out = once(staged, {
        "registered_office": blank_to_null(clean_name(F.regexp_extract("flat", rx(R.OFFICE), 1))),
        "contact_person": blank_to_null(clean_name(person)),
        "email": clean_email(F.col("_email")),
        "phone": F.when(F.col("_email").isNotNull(), by_email).otherwise(by_office),
        "website": F.regexp_replace(F.col("_site"), r"[\\)\].*;,'\"]+$", ""),
    })
    columns = ["registered_office", "contact_person", "email", "phone", "website"]
    return out.filter(F.coalesce(*columns).isNotNull()).select("doc_id", *columns)
