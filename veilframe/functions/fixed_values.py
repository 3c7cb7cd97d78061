"""Fixed values.

Everything in this module is a constant that decides results: type codes, detection
patterns, word lists, label tables, formats and messages.  No logic lives here.
"""

# --------------------------------------------------------------------------------------
# Entity types, as long name -> code stored in the data.
# --------------------------------------------------------------------------------------
ENTITY_TYPES = {
    "PERSON": "PERSON",
    "ORGANIZATION": "ORG",
    "LOCATION": "LOC",
    "ADDRESS": "ADDR",
    "EMAIL": "EMAIL",
    "PHONE": "PHONE",
    "IBAN": "IBAN",
    "CF": "CF",
    "PIVA": "PIVA",
    "CARD": "CARD",
    "DATE": "DATE",
    "AMOUNT": "AMOUNT",
    "CAP": "CAP",
    "ACCOUNT": "ACCOUNT",
    "PASSPORT": "PASSPORT",
    "ID_CARD": "ID_CARD",
    "DRIVER_LICENSE": "DRIVING_LICENSE",
    "LICENSE_PLATE": "PLATE",
    "TAX_ID": "TAX_ID",
    "BIC": "BIC",
    "CVV": "CVV",
    "CARD_EXPIRY": "CARD_EXPIRY",
    "IP_ADDRESS": "IP",
    "MAC_ADDRESS": "MAC",
    "URL": "URL",
    "USERNAME": "USERNAME",
    "EMPLOYEE_ID": "EMPLOYEE_ID",
    "MEDICAL_ID": "MEDICAL_ID",
    "INSURANCE_ID": "INSURANCE_ID",
}

# --------------------------------------------------------------------------------------
# Detection patterns, as (type, confidence, pattern), in rule order.
# The order breaks ties, a group named v marks the part that is the entity, matching
# ignores case outside (?-i:...).  The IBAN tail is written [A-Z0-9]{0,16}, which
# accepts the same strings as a repeated optional character but cannot backtrack.
# --------------------------------------------------------------------------------------
PATTERNS = [
    ("EMAIL", 0.99, r"\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,24}\b"),
    ("IBAN", 0.99, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}[A-Z0-9]{0,16}\b"),
    ("CF", 0.99, r"\b(?-i:[A-Z]{6}[0-9]{2}[ABCDEHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z])\b"),
    ("PIVA", 0.99, r"(?:P\.?\s*IVA|Partita\s+IVA)[\s:]*(?P<v>[0-9]{11})"),
    ("PHONE", 0.92,
     r"(?:\+39|0039)[\s\-\.]?(?:0[0-9]{1,3}|3[0-9]{2})[\s\-\.]?[0-9]{3,4}[\s\-\.]?[0-9]{3,4}"),
    ("PHONE", 0.85, r"\b(?:0[0-9]{1,3}|3[0-9]{2})[\s\-\.]?[0-9]{3,4}[\s\-\.]?[0-9]{3,4}\b"),
    ("PHONE", 0.80, r"(?<!\d)\+(?!39\b|0039)[1-9][0-9]{6,14}(?!\d)"),
    ("PHONE", 0.82,
     r"(?<!\d)\+(?!39(?:[\s\-.]|\d))[1-9][0-9]{0,3}[\s\-.]?[0-9](?:[\s\-.]?[0-9]){5,12}(?!\d)"),
    ("CAP", 0.65, r"\b[0-9]{5}\b"),
    ("DATE", 0.95,
     r"\b(?:0?[1-9]|[12][0-9]|3[01])[/\-\.](?:0?[1-9]|1[0-2])[/\-\.](?:19|20)[0-9]{2}\b"),
    ("DATE", 0.95,
     r"\b(?:19|20)[0-9]{2}[/\-\.](?:0?[1-9]|1[0-2])[/\-\.](?:0?[1-9]|[12][0-9]|3[01])\b"),
    ("DATE", 0.90,
     r"\b(?:0?[1-9]|[12][0-9]|3[01])°?\s+"
     r"(?:gen(?:naio)?|feb(?:braio)?|mar(?:zo)?|apr(?:ile)?|mag(?:gio)?|giu(?:gno)?"
     r"|lug(?:lio)?|ago(?:sto)?|set(?:tembre)?|ott(?:obre)?|nov(?:embre)?|dic(?:embre)?)"
     r"\.?\s+(?:19|20)[0-9]{2}\b"),
    ("DATE", 0.80,
     r"\b(?:gen(?:naio)?|feb(?:braio)?|mar(?:zo)?|apr(?:ile)?|mag(?:gio)?|giu(?:gno)?"
     r"|lug(?:lio)?|ago(?:sto)?|set(?:tembre)?|ott(?:obre)?|nov(?:embre)?|dic(?:embre)?)"
     r"\.?\s+(?:19|20)[0-9]{2}\b"),
    ("AMOUNT", 0.95, r"[€$£]\s*[0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]{1,2})?"),
    ("AMOUNT", 0.95, r"\b[0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]{1,2})?\s*(?:euro|EUR|€)\b"),
    ("AMOUNT", 0.82,
     r"(?:stipendio|salario|reddito|importo|totale|saldo|costo|prezzo|fattura|quota|rata|acconto"
     r"|rimborso|indennit[àa]|compenso|salary|income|amount|balance|total|invoice|payment|sueldo"
     r"|ingreso|importe|precio|factura|salaire|revenu|montant|solde|facture|sal[áa]rio|rendimento"
     r"|montante|pre[çc]o|fatura|gehalt|betrag|summe|rechnung|einkommen)"
     r"[\s:]*(?P<v>[0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]{1,2})?)"),
    ("CARD", 0.95,
     r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}"
     r"|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("CARD", 0.90, r"(?<![0-9])(?:[0-9]{4}[ \-]){3}[0-9]{4}(?![0-9])"),
    ("CARD", 0.90, r"(?<![0-9])[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}(?![0-9])"),
    ("BIC", 0.92,
     r"(?:BIC|SWIFT|BIC\s*/\s*SWIFT)[\s:]*(?P<v>[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"),
    ("BIC", 0.72, r"\b(?-i:[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"),
    ("CVV", 0.88,
     r"(?:CVV2?|CVC2?|CID|security\s+code|codice\s+di\s+sicurezza|c[óo]digo\s+de\s+seguridad"
     r"|cryptogramme(?:\s+visuel)?|c[óo]digo\s+de\s+seguran[çc]a|pr[üu]fziffer|sicherheitscode)"
     r"[\s:]*(?P<v>[0-9]{3,4})\b"),
    ("CARD_EXPIRY", 0.85,
     r"(?:scadenza|exp(?:iry|ires?)?(?:\s+date)?|valid\s+thru|good\s+thru|vencimiento|caducidad"
     r"|validit[ée]|expiration|validade|g[üu]ltig\s+bis|ablaufdatum)"
     r"[\s:]*(?P<v>(?:0[1-9]|1[0-2])\s*/\s*(?:[0-9]{4}|[0-9]{2}))\b"),
    ("ACCOUNT", 0.95,
     r"(?:c/c|conto\s+corrente|numero\s+conto|n[°\.]?\s*conto)[\s:]*"
     r"(?P<v>[0-9]{5}[\s\-]?[0-9]{5}[\s\-]?[0-9]{12}|[0-9]{12})"),
    ("ACCOUNT", 0.90,
     r"(?:account\s+(?:number|no\.?)|n[úu]mero\s+de\s+cuenta|num[ée]ro\s+de\s+compte"
     r"|n[úu]mero\s+de\s+conta|kontonummer)[\s:]*(?P<v>[A-Z0-9]{6,20})"),
    ("ADDR", 0.78,
     r"\b(?:Via|V\.le|Viale|Corso|C\.so|Piazza|P\.(?:zza?)?|Vicolo|Largo|Strada|Strada\s+Statale"
     r"|S\.S\.|Loc(?:alità)?\.?|Borgata|Contrada|Regione|Rione|Piazzale|Lungomare|Lungotevere)\s+"
     r"(?:dell[aeiou]?\s+|degli?\s+|dei?\s+|dello?\s+|d[i']?\s+)??"
     r"[A-ZÀ-Ùa-zà-ù][a-zà-ù]*(?:\s+[A-ZÀ-Ùa-zà-ù][a-zà-ù]*)?"
     r"(?:\s*,\s*|\s+)[0-9]+(?:\s*/\s*[A-Z0-9]+)?"),
    ("ADDR", 0.76,
     r"\b(?:Calle|C/|Avenida|Avda\.?|Plaza|Pza\.?|Paseo|Carrer|Camino|Carretera|Rue|Avenue|Av\.?"
     r"|Boulevard|Bd\.?|Place|Impasse|All[ée]e|Chemin|Quai|Route|Rua|Pra[çc]a|Travessa|Estrada"
     r"|Alameda)\s+(?:d[aeiou]s?\s+|del\s+|de\s+la\s+|du\s+|des?\s+|do[s]?\s+)??"
     r"[A-ZÀ-ÖØ-Þa-zà-öø-ÿß][\wà-öø-ÿß]*(?:\s+[A-ZÀ-ÖØ-Þa-zà-öø-ÿß][\wà-öø-ÿß]*){0,3}"
     r"(?:\s*,\s*|\s+)(?:n[°ºo.]?\s*)?[0-9]+[A-Za-z]?(?:\s*/\s*[A-Z0-9]+)?"),
    ("ADDR", 0.76,
     r"\b(?-i:[A-ZÄÖÜ][a-zäöüß]+(?:\s?[A-ZÄÖÜ][a-zäöüß]+)?"
     r"(?:stra(?:ße|sse)|str\.|weg|platz|gasse|allee|ring|damm|ufer))\s+[0-9]+[a-z]?\b"),
    ("ADDR", 0.76,
     r"\b[0-9]{1,5}\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}\s+"
     r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Square|Sq"
     r"|Place|Pl|Terrace|Ter|Highway|Hwy)\b\.?"),
    ("PERSON", 0.88,
     r"\b(?:Sig(?:\.ra?)?|Dott(?:\.ssa?)?|Dr|Prof(?:\.ssa?)?|Avv|Ing|Arch|Rag|Geom|On|Sen|Gen|Col"
     r"|Mr|Mrs|Ms|Miss|Mx|Sir|Lord|Lady|Sr|Sra|Srta|Don|Do[ñn]a|Mme|Mlle|Herr|Frau)\.?\s+"
     r"(?-i:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß]+(?:\s+[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß]+){0,3})"),
    ("PERSON", 0.75,
     r"(?:cliente|dipendente|paziente|intestatario|titolare|assicurato|beneficiario"
     r"|contatto(?:\s+(?:emergenza|di\s+emergenza))?|referente|destinatario|mittente|richiedente"
     r"|utente|nome|name|full\s+name|customer|employee|patient|client|contact|holder|policyholder"
     r"|beneficiary|recipient|sender|applicant|nombre|empleado|titular|contacto|asegurado|usuario"
     r"|remitente|nom(?:\s+complet)?|employ[ée]|titulaire|b[ée]n[ée]ficiaire|destinataire"
     r"|exp[ée]diteur|utilisateur|assur[ée]|funcion[áa]rio|contato|benefici[áa]rio"
     r"|destinat[áa]rio|remetente|utilizador|segurado|kunde|mitarbeiter|inhaber|kontakt"
     r"|empf[äa]nger|absender|benutzer|versicherter|name)[ \t]*:?[ \t]*"
     r"(?P<v>(?-i:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß'’]+(?:[ \t]+(?:de[il]?[ \t]+|d[a'][ \t]*|van[ \t]+"
     r"|von[ \t]+|della?[ \t]+|do[s]?[ \t]+)?[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß'’]+){1,3}))"),
    ("PASSPORT", 0.90,
     r"(?:passaporto|passport|pasaporte|passeport|passaporte|reisepass|pass)"
     r"(?:\s*(?:n[°ºo.]?|no\.?|nr\.?|num(?:ero|éro)?|number|#))?"
     r"[\s:]*(?P<v>[A-Z]{1,2}\s?[0-9]{6,8})\b"),
    ("ID_CARD", 0.88,
     r"(?:carta\s+d['’i]?\s*identit[àa]|carta\s+identit[àa]|documento\s+d['’i]?\s*identit[àa]"
     r"|identity\s+card|id\s+card|national\s+id|carte\s+nationale\s+d['’]identit[ée]|cni"
     r"|cart[ãa]o\s+de\s+cidad[ãa]o|bilhete\s+de\s+identidade|personalausweis"
     r"|ausweis(?:nummer)?|documento\s+nacional|dni|nie)"
     r"(?:\s*(?:n[°ºo.]?|no\.?|nr\.?|num(?:ero|éro)?|number|#))?"
     r"[\s:]*(?P<v>[A-Z]{0,2}\s?[0-9]{6,9}[ \-]?[A-Z]?)\b"),
    ("ID_CARD", 0.72, r"\b(?-i:[0-9]{8}[ \-]?[A-Z])\b"),
    ("ID_CARD", 0.80, r"\b(?-i:[XYZ][ \-]?[0-9]{7}[ \-]?[A-Z])\b"),
    ("DRIVING_LICENSE", 0.85,
     r"(?:patente(?:\s+di\s+guida)?|driver'?s?\s+licen[cs]e|driving\s+licen[cs]e"
     r"|permiso\s+de\s+conducir|permis\s+de\s+conduire|carta\s+de\s+condu[çc][ãa]o"
     r"|f[üu]hrerschein)(?:\s*(?:n[°ºo.]?|no\.?|nr\.?|num(?:ero|éro)?|number|#))?"
     r"[\s:]*(?P<v>[A-Z]{1,2}[0-9]{6,10}[A-Z]?)\b"),
    ("PLATE", 0.82,
     r"(?:targa|license\s+plate|number\s+plate|matr[íi]cula|plaque(?:\s+d['’]immatriculation)?"
     r"|kennzeichen)[\s:]*"
     r"(?P<v>(?-i:[A-Z]{1,3}[ \-]?[0-9]{1,4}[ \-]?[A-Z]{0,3}[0-9]{0,4}))\b"),
    ("TAX_ID", 0.90,
     r"(?:SSN|social\s+security(?:\s+(?:no|number))?)[\s.:#]*(?P<v>[0-9]{3}-?[0-9]{2}-?[0-9]{4})\b"),
    ("TAX_ID", 0.78, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("TAX_ID", 0.82,
     r"\b(?-i:[A-CEGHJ-PR-TW-Z]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-D])\b"),
    ("TAX_ID", 0.85,
     r"(?:VAT(?:\s+(?:no|number|reg(?:istration)?))?|tax\s+id|steuer-?id"
     r"|steueridentifikationsnummer|steuernummer|num[ée]ro\s+fiscal|n[íi]f|contribuinte)[\s.:#]*"
     r"(?P<v>[A-Z]{0,2}[0-9A-Z]{8,13})\b"),
    ("TAX_ID", 0.88,
     r"(?:s[ée]curit[ée]\s+sociale|num[ée]ro\s+de\s+s[ée]curit[ée]|nir|n[°º]?\s*s[ée]cu)[\s.:#]*"
     r"(?P<v>[12][ ]?[0-9]{2}[ ]?[0-9]{2}[ ]?[0-9AB]{2}[ ]?[0-9]{3}[ ]?[0-9]{3}(?:[ ]?[0-9]{2})?)\b"),
    ("TAX_ID", 0.85,
     r"(?:seguridad\s+social|n[úu]mero\s+de\s+afiliaci[óo]n|nuss|sozialversicherungsnummer"
     r"|seguran[çc]a\s+social|niss)[\s.:#]*(?P<v>[0-9]{2}[ /\-]?[0-9]{6,12})\b"),
    ("IP", 0.85,
     r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"),
    ("IP", 0.85, r"\b(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4}\b"),
    ("IP", 0.80, r"(?<![:.\w])(?:[A-F0-9]{1,4}:){1,6}:(?:[A-F0-9]{1,4}:?){0,5}[A-F0-9]{1,4}"),
    ("MAC", 0.92, r"\b(?:[0-9A-F]{2}[:\-]){5}[0-9A-F]{2}\b"),
    ("URL", 0.85, r"\bhttps?://[^\s<>\"')\]]+"),
    ("URL", 0.80, r"\bwww\.[A-Za-z0-9\-]+\.[A-Za-z]{2,24}(?:/[^\s<>\"')\]]*)?"),
    ("USERNAME", 0.62, r"(?<![\w@.])@[A-Za-z0-9_]{2,30}\b"),
    ("USERNAME", 0.70,
     r"(?:username|user(?:name)?|handle|nickname|account|login|utente|usuario|utilisateur"
     r"|identifiant|utilizador|benutzer(?:name)?|nutzername)"
     r"[\s:]*(?P<v>[A-Za-z0-9._\-]{3,30})\b"),
    ("EMPLOYEE_ID", 0.85,
     r"(?:matricola(?:\s+aziendale)?|employee\s+(?:id|number|no\.?)|badge\s+(?:id|number|no\.?)"
     r"|emp(?:loyee)?\s*id|staff\s+(?:id|number)|n[úu]mero\s+de\s+empleado|matricule"
     r"|num[ée]ro\s+d['’]employ[ée]|n[úu]mero\s+de\s+funcion[áa]rio|personalnummer"
     r"|mitarbeiternummer)[\s.:#]*(?P<v>[A-Z]{0,5}[-/]?[0-9]{3,10})\b"),
    ("MEDICAL_ID", 0.85,
     r"(?:cartella\s+clinica|medical\s+record(?:\s+(?:no|number))?|patient\s+(?:id|number|no\.?)"
     r"|id\s+paziente|codice\s+(?:paziente|sanitario)|health\s+id"
     r"|n[úu]mero\s+de\s+(?:paciente|historia\s+cl[íi]nica)|dossier\s+m[ée]dical"
     r"|num[ée]ro\s+de\s+patient|n[úu]mero\s+de\s+(?:utente|processo\s+cl[íi]nico)"
     r"|patientennummer|krankenakte)[\s.:#]*(?P<v>[A-Z]{0,5}[-/]?[0-9]{4,12})\b"),
    ("MEDICAL_ID", 0.78, r"\bMED[-/]?[0-9]{4,12}\b"),
    ("INSURANCE_ID", 0.85,
     r"(?:assicurazione(?:\s+sanitaria)?|polizza|health\s+insurance"
     r"|insurance(?:\s+(?:no|number|id|policy))?|policy\s+(?:no|number)|p[óo]liza|seguro"
     r"|num[ée]ro\s+(?:de\s+)?(?:police|d['’]assurance)|police\s+d['’]assurance|ap[óo]lice"
     r"|versicherungsnummer|versicherung)[\s.:#nº°]*(?P<v>[A-Z]{0,5}[-/]?[0-9]{6,14})\b"),
    ("INSURANCE_ID", 0.78, r"\bINS[-/]?[0-9]{6,14}\b"),
]

# --------------------------------------------------------------------------------------
# Check-character weights of the Italian fiscal code for characters at odd
# positions (first, third, ...), digits 0-9 and letters A-Z.
# --------------------------------------------------------------------------------------
FISCAL_ODD_DIGITS = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21]
FISCAL_ODD_LETTERS = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14,
                      16, 10, 22, 25, 24, 23]

# --------------------------------------------------------------------------------------
# Column-name keywords and the type they announce, first hit wins.
# --------------------------------------------------------------------------------------
HEADER_KEYWORDS = [
    ("PERSON", ["nome", "cognome", "name", "surname", "persona", "intestatario", "titolare",
                "nombre", "apellido", "nom", "prénom", "prenom", "sobrenome", "vorname",
                "nachname", "kunde"]),
    ("EMAIL", ["email", "mail", "e-mail", "posta", "correo", "courriel", "correio"]),
    ("PHONE", ["telefono", "tel", "phone", "cellulare", "mobile", "fax", "teléfono", "téléphone",
               "telefone", "telefon", "móvil", "movil", "handy", "celular"]),
    ("IBAN", ["iban", "conto corrente", "conto", "account"]),
    ("CF", ["codice fiscale", "cf", "fiscal", "codfis", "codfisc"]),
    ("PIVA", ["partita iva", "p.iva", "piva", "vat"]),
    ("ADDR", ["indirizzo", "address", "via", "street", "residenza", "domicilio", "dirección",
              "direccion", "calle", "adresse", "rue", "morada", "rua", "anschrift", "straße",
              "strasse"]),
    ("CAP", ["cap", "zip", "postal", "código postal", "codigo postal", "code postal", "plz",
             "postleitzahl"]),
    ("DATE", ["data", "date", "nascita", "birth", "nato", "fecha", "nacimiento", "naissance",
              "geburt", "geburtsdatum", "nascimento"]),
    ("AMOUNT", ["importo", "amount", "totale", "saldo", "stipendio", "reddito", "costo", "prezzo",
                "euro"]),
    ("CARD", ["carta", "card", "cc", "cvv", "credito"]),
    ("LOC", ["citta", "città", "city", "comune", "paese", "localita", "località", "location"]),
    ("ORG", ["organizzazione", "azienda", "societa", "società", "company", "org", "datore"]),
    ("PASSPORT", ["passaporto", "passport"]),
    ("ID_CARD", ["carta identita", "carta d'identita", "carta d identita", "documento", "id card",
                 "identity"]),
    ("DRIVING_LICENSE", ["patente", "driving licence", "driving license", "driver licence",
                         "driver license"]),
    ("PLATE", ["targa", "license plate", "number plate", "plate"]),
    ("TAX_ID", ["ssn", "social security", "national insurance", "nino", "tax id", "vat"]),
    ("BIC", ["bic", "swift"]),
    ("CVV", ["cvv", "cvc", "security code"]),
    ("CARD_EXPIRY", ["scadenza", "expiry", "exp date", "valid thru"]),
    ("IP", ["ip", "indirizzo ip", "ip address"]),
    ("MAC", ["mac", "mac address"]),
    ("URL", ["url", "link", "sito", "website"]),
    ("USERNAME", ["username", "user", "utente", "handle", "nickname", "login"]),
    ("EMPLOYEE_ID", ["matricola", "employee id", "badge", "staff id", "emp"]),
    ("MEDICAL_ID", ["cartella clinica", "medical record", "patient id", "paziente", "health id"]),
    ("INSURANCE_ID", ["assicurazione", "polizza", "insurance", "policy"]),
]

# --------------------------------------------------------------------------------------
# Labels of the three outside entity recognisers and the type they mean.
# GLiNER labels are looked up in lower case.
# --------------------------------------------------------------------------------------
RECOGNISER_LABELS = {
    "spacy": {
        "PER": "PERSON",
        "PERSON": "PERSON",
        "ORG": "ORG",
        "LOC": "LOC",
        "GPE": "LOC",
        "FAC": "ADDR",
    },
    "gliner": {
        "person": "PERSON",
        "organization": "ORG",
        "location": "LOC",
        "address": "ADDR",
        "email": "EMAIL",
        "phone number": "PHONE",
        "iban": "IBAN",
        "fiscal code": "CF",
        "date of birth": "DATE",
        "monetary amount": "AMOUNT",
        "credit card number": "CARD",
        "bank account number": "ACCOUNT",
        "passport number": "PASSPORT",
        "identity card number": "ID_CARD",
        "driver license number": "DRIVING_LICENSE",
        "license plate": "PLATE",
        "social security number": "TAX_ID",
        "vat number": "TAX_ID",
        "ip address": "IP",
        "mac address": "MAC",
        "url": "URL",
        "username": "USERNAME",
        "employee id": "EMPLOYEE_ID",
        "medical record number": "MEDICAL_ID",
        "insurance policy number": "INSURANCE_ID",
    },
    "presidio": {
        "PERSON": "PERSON",
        "PHONE_NUMBER": "PHONE",
        "EMAIL_ADDRESS": "EMAIL",
        "IBAN_CODE": "IBAN",
        "CREDIT_CARD": "CARD",
        "LOCATION": "LOC",
        "ORGANIZATION": "ORG",
        "DATE_TIME": "DATE",
        "IT_FISCAL_CODE": "CF",
        "IP_ADDRESS": "IP",
        "URL": "URL",
        "US_SSN": "TAX_ID",
        "US_ITIN": "TAX_ID",
        "US_PASSPORT": "PASSPORT",
        "US_DRIVER_LICENSE": "DRIVING_LICENSE",
        "US_BANK_NUMBER": "ACCOUNT",
        "UK_NHS": "MEDICAL_ID",
        "UK_NINO": "TAX_ID",
        "MEDICAL_LICENSE": "MEDICAL_ID",
        "IT_DRIVER_LICENSE": "DRIVING_LICENSE",
        "IT_PASSPORT": "PASSPORT",
        "IT_IDENTITY_CARD": "ID_CARD",
        "IT_VAT_CODE": "PIVA",
        "CRYPTO": "ACCOUNT",
    },
}

# The confidence given to recognisers that report none.
RECOGNISER_DEFAULT_SCORE = {"spacy": 0.85, "gliner": 0.8, "presidio": 0.0}

# --------------------------------------------------------------------------------------
# Field labels that recognisers mistake for names, and articles that they
# attach to names (it, en, es, fr, pt, de).
# --------------------------------------------------------------------------------------
FIELD_WORDS = [
    "attenzione", "cliente", "dipendente", "paziente", "contatto", "relazione", "scadenza", "note",
    "documento", "indirizzo", "telefono", "matricola", "assicurazione", "polizza", "passaporto",
    "patente", "targa", "email", "data", "nascita", "intestatario", "titolare", "beneficiario",
    "referente", "destinatario", "mittente", "richiedente",
    "name", "customer", "employee", "patient", "contact", "relationship", "expiry", "notes",
    "address", "phone", "passport", "license", "insurance", "policy", "holder", "beneficiary",
    "recipient", "sender",
    "atención", "atencion", "nombre", "apellido", "empleado", "asegurado", "titular", "contacto",
    "dirección", "direccion", "teléfono", "fecha", "nacimiento", "usuario", "póliza", "poliza",
    "seguro", "cuenta",
    "attention", "nom", "prénom", "prenom", "client", "employé", "employe", "assuré", "assure",
    "adresse", "téléphone", "telephone", "naissance", "destinataire", "expéditeur", "expediteur",
    "utilisateur",
    "atenção", "atencao", "funcionário", "funcionario", "morada", "telefone", "nascimento",
    "segurado", "apólice", "apolice", "utilizador",
    "achtung", "kunde", "mitarbeiter", "anschrift", "telefon", "geburtsdatum", "versicherter",
    "versicherung", "benutzer", "konto", "vorname", "nachname",
]
ARTICLES = [
    "il", "lo", "la", "i", "gli", "le", "l", "un", "uno", "una",
    "the", "a", "an",
    "el", "los", "las", "unos", "unas",
    "les", "des", "du", "de",
    "o", "os", "as", "um", "uma",
    "der", "die", "das", "den", "dem", "ein", "eine", "einen",
]

# --------------------------------------------------------------------------------------
# Formats, limits and messages.
# --------------------------------------------------------------------------------------
TOKEN_FORMAT = "[%s_%03d]"
TOKEN_PATTERN = r"\[[A-Za-z_]+_[0-9]{3,}\]"          # any case, for restoring and checking
CHUNK_TOKEN_PATTERN = r"\[[A-Z_]+_[0-9]{3,}\]"       # upper case only, for cutting
REDACTED = "[REDACTED]"

DEFAULT_THRESHOLD = 0.7
BOOST = 0.05
BOOST_CEILING = 0.99
DEFAULT_CHUNK_CHARS = 12_000
CHUNK_PROBE_CHARS = 16
MAX_TEXT_CHARS = 100_000
MAX_UPLOAD_BYTES = 5_000_000
MAX_MAPPING_ENTRIES = 20_000
SILENT_TEXT_CHARS = 100
SESSION_TTL_SECONDS = 1800
RATE_MAX_REQUESTS = 240
RATE_WINDOW_SECONDS = 60
KDF_ITERATIONS = 480_000
KDF_SALT_BYTES = 16

SUPPORTED_SUFFIXES = [".txt", ".pdf", ".csv", ".docx", ".json"]

DEFAULT_PROMPT = "Analizza il seguente testo:\n\n{document}"
PART_FORMAT = "[Parte %d di %d]\n\n"
DEMO_PREVIEW_LINES = 8
DEMO_HEAD = (
    "[DEMO - nessuna API key richiesta]\n\n"
    "Il documento anonimizzato è stato elaborato. "
    "I dati sensibili sono stati sostituiti con placeholder prima dell'invio.\n\n"
    "Anteprima testo ricevuto (prime righe):\n"
)
DEMO_TAIL = (
    "\n\nPer usare un LLM reale, specificare --provider openai|anthropic|gemini|ollama "
    "con la relativa API key."
)

LEAK_ERROR = "Dato originale trapelato nel testo anonimizzato: '%s'"
UNKNOWN_TOKEN_ERROR = "Token sconosciuto nel testo anonimizzato: %s"
LEFT_TOKEN_ERROR = "Token non sostituito nella risposta finale: %s"
INVENTED_TOKEN_ERROR = "Placeholder inventato dall'LLM: %s"
UNSUPPORTED_FORMAT_ERROR = "Formato non supportato: %s"
UNKNOWN_TYPE_ERROR = "Tipo entità sconosciuto: '%s'. Valori validi: %s"
UNSAFE_ERROR = "Anonimizzazione non sicura: pipeline interrotta prima dell'invio all'LLM."
