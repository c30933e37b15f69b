"""The default controlled vocabulary. Operators take terms as parameters; these are only defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam.functions.text import SPACE, let, strip

# Fixed values, in natural order.
SERVICES = ["smb", "ldap", "kerberos", "winrm", "rdp", "mssql", "mysql", "postgres", "nginx", "apache", "iis", "ssh", "ftp", "dns", "smtp", "rpc", "nfs", "active directory", "adcs", "jenkins", "tomcat", "wordpress"]
TECHNIQUES = ["kerberoasting", "as-rep roasting", "password spraying", "ntlm relay", "constrained delegation", "unconstrained delegation", "acl abuse", "privilege escalation", "sql injection", "lfi", "rfi", "ssrf", "ssti", "xss", "deserialization", "pass the hash", "dcsync", "golden ticket", "silver ticket", "rbcd", "shadow credentials", "certifried", "esc1"]
TOOLS = ["nmap", "ffuf", "gobuster", "feroxbuster", "burp", "impacket", "bloodhound", "responder", "hashcat", "john", "metasploit", "evil-winrm", "crackmapexec", "netexec", "rubeus", "mimikatz", "certipy", "wpscan", "sqlmap", "nikto", "hydra", "smbclient", "ldapsearch", "rpcclient"]
CASE_MARKERS = ["htb", "hackthebox", "ctf", "writeup", "pg", "proving grounds", "oscp", "thm", "tryhackme", "vulnhub"]
ALIASES = {"kerberoast": "kerberoasting", "asreproast": "as-rep roasting", "asrep roasting": "as-rep roasting", "as rep roasting": "as-rep roasting", "password spray": "password spraying", "pth": "pass the hash", "resource-based constrained delegation": "rbcd", "resource based constrained delegation": "rbcd", "sqli": "sql injection", "local file inclusion": "lfi", "remote file inclusion": "rfi", "server-side request forgery": "ssrf", "server-side template injection": "ssti", "cross-site scripting": "xss"}
VOCABULARY = {"service": SERVICES, "technique": TECHNIQUES, "tool": TOOLS}


def found_terms(text: Column, terms: list[str]) -> Column:
    """Sorted distinct terms that occur in the lower-cased text, as substrings."""
    literal = F.array(*map(F.lit, sorted(set(terms)))) if terms else F.array().cast("array<string>")
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(literal, lambda t: F.contains(low, t)))


def signals(text: Column, vocabulary: dict[str, list[str]] | None = None) -> Column:
    """struct of the found terms of each kind."""
    vocabulary = vocabulary or VOCABULARY
    return F.struct(*(found_terms(text, terms).alias(kind) for kind, terms in vocabulary.items()))


def resolve_technique(name: Column, techniques: list[str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """The canonical term, or null. Case and white space do not matter."""
    key = strip(F.regexp_replace(F.lower(name), f"{SPACE}+", " "))
    known = {t: t for t in (TECHNIQUES if techniques is None else techniques)}
    table = (ALIASES if aliases is None else aliases) | known
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def is_case_category(categories: Column, markers: list[str] | None = None) -> Column:
    wanted = CASE_MARKERS if markers is None else markers
    return F.coalesce(F.exists(categories, lambda c: F.lower(strip(c)).isin(wanted)), F.lit(False)) if wanted else F.lit(False)
