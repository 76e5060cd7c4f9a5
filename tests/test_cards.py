"""Driver licences and their addresses against a plain Python reading from right to left."""

import random
import re

from fieldwright.operators import cards

CAPITALS = {"APT", "PO", "NE", "NW", "SE", "SW", "N", "S", "E", "W", "USA", "US"}
STREET = r"\b(AVE|AVENUE|ST|STREET|BLVD|BOULEVARD|RD|ROAD|DR|DRIVE|LN|LANE|CT|COURT|PL|PLACE|WAY|HWY|HIGHWAY|PKWY|PARKWAY|CIR|CIRCLE|TER|TERRACE|TRL|TRAIL|SQ|SQUARE)\b"


def title(s):
    def word(t):
        if t.upper() in CAPITALS:
            return t.upper()
        m = re.match(r"^([^\W\d_'’]|['’])+", t)
        return m[0][0].upper() + m[0][1:].lower() + t[m.end() :] if m else t

    return " ".join("-".join(map(word, seg.split("-"))) for seg in s.split(" "))


def address(lines):
    for i, line in enumerate(lines):
        for m in re.finditer(r"(?<!\d)(\d{5}(?:-\d{4})?)(?!\d)", line, re.A):
            before = line[: m.start()].strip()
            states = list(re.finditer(r"\b([A-Z]{2})\b", before, re.A))
            if not states:
                continue
            rest = re.sub(r"[,\s]+$", "", before[: states[-1].start()]).strip()
            city = street = ""
            if re.search("[A-Za-z]", rest):
                if "," in rest:
                    parts = [p.strip() for p in rest.split(",") if p.strip()]
                    street, city = ", ".join(parts[:-1]), parts[-1]
                else:
                    words, tail = rest.split(), []
                    while words and not re.search(r"\d", words[-1]):
                        tail.insert(0, words.pop())
                    city, street = " ".join(tail), " ".join(words)
            if not street:
                for t in [x.strip() for x in reversed(lines[max(0, i - 4) : i])]:
                    if re.match(r"\d", t) and len(t) >= 4 and (re.search(STREET, t, re.I | re.A) or re.search("[A-Z][A-Z]+", t)):
                        street = t
                        break
            if not city and i > 0 and (c := re.search(r"([A-Z][A-Z .'\-]*[A-Z])\s*$", lines[i - 1].strip())):
                city = c[1]
            if city or street:
                return {"us_address_street": title(street) if street else "", "us_address_city": title(re.sub(",+$", "", city).strip()) if city else "", "us_address_state": states[-1][1], "us_address_zip": m[1]}
    return None


PATTERNS = {"dl_number": r"\bDL\s+([A-Z0-9]+)\b", "family_name": r"\bLN\s+([A-Z][A-Z'\-]+)\b", "given_name": r"\bFN\s+([A-Z][A-Z'\- ]+?)(?:\s{2,}|$)", "dob": r"\bDOB\s+(\d{2}/\d{2}/\d{4})\b", "sex": r"\bSEX\s*:?\s*([MFX])\b", "height": r"\bHGT\s+(\d\s*['′]\s*[-\s]*\d{1,2}\s*[\"″])", "weight": r"(?i)\bWGT\s+(\d{2,3}\s*(?:lb|kg))", "eye_color": r"\bEYES\s+([A-Z]{3})\b", "hair_color": r"\bHAIR\s+([A-Z]{3})\b"}


def plain(text):
    lines, out = (text or "").split("\n"), {}
    for name, pattern in PATTERNS.items():
        v = next((m[1] for t in lines if (m := re.search(pattern, t, re.A))), None)
        if v:
            out[name] = title(v.strip()) if name.endswith("_name") else f"{v[6:]}-{v[:2]}-{v[3:5]}" if name == "dob" else re.sub(r"\s+", "", v).replace("′", "'").replace("″", '"') if name == "height" else v
    out |= {k: v for k, v in (address(lines) or {}).items() if v}
    return out if len(out) >= 3 else None


def texts():
    r = random.Random(2)
    anchors = ["DL F8904182", "DL d12", "LN O'NEIL-SMITH", "LN IVANENKO", "FN TARAS HRYHOROVYCH", "FN ANNA  DOB 01/02/1990", "DOB 03/04/1985", "SEX M", "SEX: F HAIR BRN", "HGT 6 ' - 06 \"", "WGT 231 lb", "wgt 78 kg EYES BLU", "HAIR BLK", "EXP 08/08/2027", "ISS 12345"]
    places = ["LOS ANGELES, CA 90029", "4341 WILLOW BROOK AVE 111 LOS ANGELES CA 90029-1234", "4341 WILLOW BROOK AVE 111", "WINSTON-SALEM, NC 27101", "CA 90029", "12 Main st, Apt 4, Salt Lake City, UT 84101", "90029", "ID 12345678", "DD 00/00/00 12345 XX", "NEW YORK NY 10001 or TX 73301", "77 lowercase road", "77 road", "PO BOX 12 NE", "ST. PAUL'S", ", , CA 90210", "1234567 CA", "12345-67890 CA 54321", "", "  ", "a b"]
    out = [None, "", "hello", "4341 WILLOW BROOK AVE\nLOS ANGELES, CA 90029\nDL X1"]
    for _ in range(400):
        out.append("\n".join(r.choice(anchors if r.random() < 0.5 else places) for _ in range(r.randint(1, 9))))
    return out


def test_cards_equal_a_plain_reading(spark):
    items = texts()
    rows = {r.doc: r for r in cards.licence_cards(spark.createDataFrame(list(enumerate(items)), "doc int, text string").repartition(4)).collect()}
    assert len(rows) == len(items)
    for i, text in enumerate(items):
        want = plain(text)
        assert rows[i].matched == (want is not None), text
        assert {f.field: f.normalized for f in rows[i].fields} == (want or {}), text
        found = address((text or "").split("\n"))
        assert rows[i].warnings == (["too_few_anchors"] if want is None else ["address_not_detected"] if found is None else ["address_partial"] if not (found["us_address_street"] and found["us_address_city"]) else [])
