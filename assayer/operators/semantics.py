"""What a column's name means: the standard name, how sure that is, and the renaming that follows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Standard names and the spellings that stand for them; the first that fits counts.
SPELLINGS = {
    "FirstName": ["fname", "first name", "firstname", "f_name", "given_name", "givenname", "first_name"],
    "LastName": ["lname", "last name", "lastname", "l_name", "surname", "family_name", "familyname", "last_name"],
    "FullName": ["name", "fullname", "full name", "customer_name", "person_name", "full_name"],
    "MiddleName": ["mname", "middle name", "middlename", "m_name", "middle_name"],
    "Email": ["email_address", "emailaddress", "e_mail", "mail", "email_id", "contact_email", "email"],
    "Phone": ["phone_number", "phonenumber", "telephone", "tel", "mobile", "cell", "contact_number", "phone_no", "phone"],
    "Address": ["street_address", "streetaddress", "addr", "address_line_1", "address1", "street", "address"],
    "City": ["town", "municipality", "locality", "city"],
    "State": ["province", "region", "state_code", "state_province", "state"],
    "Country": ["nation", "country_code", "country_name", "country"],
    "ZipCode": ["zipcode", "postal_code", "postalcode", "zip", "postcode", "pin_code", "pincode", "zip_code"],
    "price": ["amount", "cost", "total_cost", "unit_price", "sale_price", "value"],
    "quantity": ["qty", "count", "units", "amount", "num_items"],
    "total": ["total_amount", "grand_total", "sum", "total_value"],
    "discount": ["discount_amount", "disc", "rebate"],
    "tax": ["tax_amount", "vat", "gst", "sales_tax"],
    "date": ["dt", "datetime", "timestamp", "created_at", "updated_at"],
    "created_date": ["created_at", "creation_date", "date_created", "create_date"],
    "updated_date": ["updated_at", "modification_date", "date_updated", "update_date", "modified_at"],
    "birth_date": ["dob", "date_of_birth", "birthdate", "birthday"],
    "id": ["identifier", "record_id", "row_id", "uid", "uuid"],
    "customer_id": ["cust_id", "customerid", "customer_no", "customer_number", "client_id"],
    "order_id": ["orderid", "order_no", "order_number", "order_ref"],
    "product_id": ["productid", "prod_id", "item_id", "sku", "product_code"],
    "employee_id": ["emp_id", "employeeid", "staff_id", "worker_id"],
    "status": ["state", "condition", "status_code", "current_status"],
    "active": ["is_active", "enabled", "active_flag"],
    "gender": ["sex", "gender_code"],
    "age": ["years_old", "customer_age"],
}
# Patterns searched in a lower-case name, the standard name and the confidence; the first that fits counts.
HINTS = [
    ("email", "email", 0.85),
    ("phone|tel|mobile|cell", "phone", 0.85),
    ("name.*first|first.*name", "first_name", 0.80),
    ("name.*last|last.*name|surname", "last_name", 0.80),
    ("full.*name|^name$", "full_name", 0.75),
    ("address|addr|street", "address", 0.80),
    ("city|town", "city", 0.85),
    ("state|province", "state", 0.85),
    ("country|nation", "country", 0.85),
    ("zip|postal|postcode", "zip_code", 0.85),
    ("price|cost|amount", "price", 0.75),
    ("date|time", "date", 0.70),
    ("birth|dob", "birth_date", 0.85),
    ("creat", "created_date", 0.75),
    ("updat|modif", "updated_date", 0.75),
    ("status|state", "status", 0.70),
    ("gender|sex", "gender", 0.85),
    ("age", "age", 0.80),
    ("qty|quantity", "quantity", 0.85),
    ("id$", "id", 0.70),
    ("customer.*id|cust.*id", "customer_id", 0.85),
    ("order.*id|order.*no", "order_id", 0.85),
    ("product.*id|prod.*id|sku", "product_id", 0.85),
]


def meaning(name: str, custom: dict[str, str] | None = None, threshold: float = 0.7, hints: bool = True) -> tuple[str, str, float, str | None]:
    """(standard name, status, confidence, source) of one column name.

    Own names come first (as spelled, then lower-case), then standard names and their spellings, then hints; a hint below the
    threshold is told, not taken for a match. Other names stay as they are.
    """
    low = name.lower().strip()
    own = (custom or {}).get(name) or (custom or {}).get(low)
    if own:
        return own, "mapped", 1.0, "custom"
    plain = re.sub("[^a-z0-9]", "_", low).strip("_")
    for standard, spellings in SPELLINGS.items():
        if low == standard or plain == standard.replace("_", ""):
            return standard, "mapped", 1.0, "standard"
        if low in spellings or plain in {re.sub("[^a-z0-9]", "", s) for s in spellings}:
            return standard, "mapped", 0.95, "standard_variant"
    for pattern, standard, sure in HINTS if hints else ():
        if re.search(pattern, low):
            return standard, "mapped" if sure >= threshold else "low_confidence", sure, "pattern_detection"
    return name, "unmapped", 0.0, None


def column_semantics(df: DataFrame, custom: dict[str, str] | None = None, threshold: float = 0.7, hints: bool = True) -> DataFrame:
    """One row per column of df: its name and what it means. Reads the schema alone, so an empty table gives the same rows."""
    rows = [(c, *meaning(c, custom, threshold, hints)) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "original_name string, standard_name string, status string, confidence double, mapping_source string")


def standard_names(df: DataFrame, custom: dict[str, str] | None = None, threshold: float = 0.7, hints: bool = True) -> DataFrame:
    """df under standard names, rows unchanged. Only mapped columns are renamed; where two would take one name, or a
    column has it already, the first column takes it and the other keeps its own."""
    taken = {c.lower() for c in df.columns}
    names = []
    for c in df.columns:
        to, status, _, _ = meaning(c, custom, threshold, hints)
        if status == "mapped" and (to.lower() == c.lower() or to.lower() not in taken):
            taken.add(to.lower())
            names.append(to)
        else:
            names.append(c)
    return df.toDF(*names)
