"""What entity extraction looks for: patterns and vocabularies, as data.

Patterns are Java regular expressions with Unicode classes; a pattern with a group captures the end of its match.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

# Label, pattern and whether the case counts, in the order in which entities are listed.
PATTERNS = [
    ("IP", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", True),
    ("DOMAIN", r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[A-Za-z]{2,}\b", True),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", True),
    ("HASH_MD5", r"\b[a-fA-F0-9]{32}\b", True),
    ("HASH_SHA1", r"\b[a-fA-F0-9]{40}\b", True),
    ("HASH_SHA256", r"\b[a-fA-F0-9]{64}\b", True),
    ("MITRE_TECH", r"\bT\d{4}(?:\.\d{3})?\b", False),
    ("CVE", r"\bCVE-\d{4}-\d{4,7}\b", False),
    ("URL", r"\bhttps?://[^\s<>\"{}|\\^`\[\]]+", False),
    ("FILE_PATH", r"\b(?:[A-Za-z]:)?(?:[/\\][\w\s\-_.]+)+\.(?:exe|dll|bat|cmd|ps1|vbs|js|jar|py|sh|bin|scr|com|pif|lnk)\b", False),
    ("REGISTRY", r"\b(?:HKEY_|HKLM|HKCU|HKCR|HKU|HKCC)[\\\w\s\-_.]+", False),
    ("PORT", r"\b(?:port|端口)[\s:：]?(\d{1,5})\b", False),
    ("PROCESS", r"\b(?:process|进程)[\s:：]?([A-Za-z][\w\s\-_.]+\.(?:exe|dll|bat|cmd|ps1))\b", False),
    ("SERVICE", r"\b(?:service|服务)[\s:：]?([A-Za-z][\w\s\-_.]+)\b", False),
    ("USER_AGENT", r"\bUser-Agent[\s:：][^\n\r]+", False),
    ("FILE_EXT", r"\.(?:exe|dll|bat|cmd|ps1|vbs|js|jar|py|sh|bin|scr|com|pif|lnk|doc|docx|xls|xlsx|pdf|zip|rar|7z)\b", False),
    ("OPERATION", r"\bOperation\s+[A-Z][a-zA-Z0-9\s-]+\b", False),
    ("CAMPAIGN", r"\b(?:Campaign|行动|活动)[\s:：]?([A-Z][a-zA-Z0-9\s-]+)\b", False),
    ("SSL_CERT", r"\b(?:SSL|TLS|证书|certificate)[\s:：]?(?:serial|序列号)?[\s:：]?([a-fA-F0-9:]{20,})\b", False),
    ("CWE", r"\bCWE-\d+\b", False),
    ("INDUSTRY", r"\b(?:金融|能源|医疗|政府|教育|制造业|technology|financial|energy|healthcare|government|education|manufacturing|defense|telecommunications|media|aerospace|transportation|retail)\b", False),
    ("CITY", r"\b(?:北京|上海|广州|深圳|杭州|南京|武汉|成都|西安|重庆|New York|London|Moscow|Tokyo|Berlin|Paris|Washington|Beijing|Shanghai|Bangkok|Seoul|Pyongyang|Tehran|Hanoi|Taipei|Hong Kong)\b", False),
    ("HOSTNAME", r"\b(?:host|主机|server|服务器)[\s:：]?([a-zA-Z0-9][a-zA-Z0-9\-\.]+)\b", False),
    ("USER_ACCOUNT", r"\b(?:user|用户|account|账户|username)[\s:：]?([a-zA-Z0-9_\.\-@]+)\b", False),
    ("THREAT_INTEL_SOURCE", r"\b(?:FireEye|CrowdStrike|Mandiant|Kaspersky|Symantec|Trend Micro|Palo Alto|奇安信|360|安天|微步在线|VirusTotal|AlienVault|OTX|MITRE|ATT&CK|Unit 42|Talos|Cylance|Proofpoint|Secureworks)\b", False),
]
# What stands in every text that a pattern matches: literals, one of which must be there in folded text, and a pattern for the rest.
GUARDS: dict[str, tuple[list[str], str]] = {
    "IP": (["."], r"[0-9]\.[0-9]"),
    "DOMAIN": (["."], r"[a-z0-9]\.[a-z]{2}"),
    "EMAIL": (["@"], ""),
    "HASH_MD5": ([], r"[a-f0-9]{32}"),
    "HASH_SHA1": ([], r"[a-f0-9]{40}"),
    "HASH_SHA256": ([], r"[a-f0-9]{64}"),
    "MITRE_TECH": ([], r"t\p{Nd}{4}"),
    "CVE": (["cve-"], ""),
    "URL": (["://"], ""),
    "FILE_PATH": (["/", "\\"], r"\.[a-z]"),
    "REGISTRY": (["hk"], ""),
    "PORT": (["port", "端口"], ""),
    "PROCESS": (["process", "进程"], ""),
    "SERVICE": (["service", "服务"], ""),
    "USER_AGENT": (["user-agent"], ""),
    "FILE_EXT": (["."], r"\.[a-z7]"),
    "OPERATION": (["operation"], ""),
    "CAMPAIGN": (["campaign", "行动", "活动"], ""),
    "SSL_CERT": (["ssl", "tls", "证书", "certificate"], ""),
    "CWE": (["cwe-"], ""),
    "HOSTNAME": (["host", "主机", "server", "服务器"], ""),
    "USER_ACCOUNT": (["user", "用户", "account", "账户"], ""),
}
#: Tests of folded text that several guards share, made once: a text must pass the test of a label before its guard is tried.
GATES: dict[str, tuple[str, list[str]]] = {
    "__dot": (r"\.[a-z0-9]", ["IP", "DOMAIN", "FILE_PATH", "PROCESS", "FILE_EXT"]),
    "__hex": (r"[a-f0-9]{32}", ["HASH_MD5", "HASH_SHA1", "HASH_SHA256"]),
}
# Texts that are no entities, in lower case.
BLACKLIST = [
    "cnc", "is", "encoded", "victim", "ip", "address", "id", "name", "data", "list", "file", "url", "domain", "host", "server", "user", "account",
    "password", "email", "hash", "unknown", "none", "null", "true", "false", "test", "sample", "example", "com", "net", "org", "cn", "gov", "edu",
    "www", "http", "https",
]
# Tools.
TOOLS = [
    "mshta", "regsvr32", "cmstp", "installutil", "msbuild", "cscript", "wscript", "at.exe", "schtasks.exe", "net.exe", "whoami.exe", "ipconfig.exe",
    "mimikatz", "pssexec", "psexec", "powershell", "cmd", "rundll32", "wmic", "net", "sc", "reg", "certutil", "bitsadmin", "cobalt strike",
    "cobaltstrike", "metasploit", "empire", "bloodhound", "nmap", "wireshark", "ida", "ghidra", "ollydbg", "x64dbg", "procmon", "procexp", "autoruns",
    "sysinternals", "tor", "onion", "bitcoin", "monero", "china chopper", "caidao", "burpsuite", "sqlmap", "fofa", "shodan", "censys", "winrar",
    "7zip", "putty", "winscp", "teamviewer", "anydesk", "beef", "webbug", "netsh", "schtasks", "tasklist", "taskkill", "ipconfig", "whoami",
    "systeminfo", "nbtstat", "netstat", "route", "arp", "nslookup", "ping", "tracert", "telnet", "ftp", "tftp", "powershell.exe", "cmd.exe", "bash",
    "sh", "python", "perl", "ruby", "gcc", "make", "cknife", "antsword", "behinder", "godzilla", "dnscat2", "frp", "gost", "ngrok", "chisel", "plink",
    "regeorg", "tunna", "lcx", "htran", "ew", "termite", "ladon", "crackmapexec", "impacket", "responder", "mitm6", "rubeus", "seatbelt", "sharpound",
    "sharpdump", "sharpwmi", "sharpssh", "sharpchrome", "safetykatz", "dumpert", "procdump", "lsassy", "nanodump", "minidump", "powerploit",
    "nishang", "poshc2", "covenant", "sliver", "mythic", "brute ratel", "havoc", "merlin", "shad0w",
]
# Countries.
COUNTRIES = [
    "China", "North Korea", "Russia", "USA", "United States", "Iran", "Vietnam", "India", "Pakistan", "South Korea", "Japan", "Germany", "UK",
    "France", "Israel", "Thailand", "Philippines", "Taiwan", "Hong Kong", "Ukraine", "Belarus", "Syria", "Iraq", "Afghanistan", "Saudi Arabia",
    "Turkey", "Brazil", "Mexico", "Canada", "Australia", "Netherlands", "Belgium", "Switzerland", "Sweden", "Norway", "Finland", "Denmark", "Poland",
    "Czech Republic", "Romania", "Bulgaria", "Greece", "Italy", "Spain", "Portugal", "Egypt", "UAE", "Qatar", "Kuwait", "Jordan", "Lebanon",
    "Malaysia", "Indonesia", "Singapore", "Estonia", "Latvia", "Lithuania", "Moldova", "Georgia", "Kazakhstan", "Uzbekistan", "Azerbaijan", "Armenia",
    "Venezuela", "Colombia", "Argentina", "Chile", "Peru", "South Africa", "Nigeria", "Kenya", "Ethiopia",
]
# Organisations.
ORGANISATIONS = [
    "Flax Typhoon", "Volt Typhoon", "Salt Typhoon", "Midnight Blizzard", "Star Blizzard", "Google", "Microsoft", "Adobe", "Oracle", "Cisco",
    "FireEye", "CrowdStrike", "Mandiant", "Kaspersky", "Symantec", "Trend Micro", "Palo Alto Networks", "Sony", "Sony Pictures", "Boyusec",
    "Hacking Team", "Gamma Group", "NSO Group", "FBI", "NSA", "CIA", "MSS", "PLA", "Unit 61398", "Lazarus", "Equation Group", "Shadow Brokers",
    "Barium", "Lead", "Winnti", "Axiom", "Comment Crew", "Putter Panda", "Stone Panda", "Deep Panda", "Numbered Panda", "Samurai Panda",
    "Gothic Panda", "Anchor Panda", "Mustang Panda", "Aquatic Panda", "Red Delta", "Wicked Panda", "Emissary Panda", "Judgement Panda", "Karma Panda",
    "Maverick Panda", "Nomad Panda", "Sneaky Panda", "Union Panda", "Violin Panda", "Vixen Panda", "Wet Panda", "Energetic Bear", "Berserk Bear",
    "Cozy Bear", "Fancy Bear", "Venomous Bear", "Voodoo Bear", "Primitive Bear", "Static Kitten", "Charming Kitten", "Magic Kitten", "Rocket Kitten",
    "Refined Kitten", "Helix Kitten", "Remix Kitten", "Pioneer Kitten", "Vampire Kitten", "Nemesis Kitten", "Muren Shark", "Mythic Leopard",
    "OceanLotus", "DarkHotel", "Kimsuky", "Konni", "Reaper", "Scarcruft", "Group123", "Tonto Team", "Tick", "Rancor", "Gallmaker", "Naikon", "APT1",
    "APT3", "APT10", "APT12", "APT16", "APT17", "APT18", "APT19", "APT21", "APT27", "APT28", "APT29", "APT30", "APT32", "APT33", "APT34", "APT35",
    "APT37", "APT38", "APT39", "APT40", "APT41", "Lockheed Martin", "Boeing", "Raytheon", "Northrop Grumman", "General Dynamics", "BAE Systems",
    "Thales", "Airbus", "Safran", "Mitsubishi Heavy Industries", "Kawasaki Heavy Industries", "IHI Corporation", "Hitachi", "Toshiba", "NEC",
    "Fujitsu", "NTT", "KDDI", "SoftBank", "SK Hynix", "Samsung", "LG", "Hyundai", "Daewoo", "Posco", "Lotte", "Hanwha", "Petrobras", "Pemex",
    "Saudi Aramco", "Qatar Petroleum", "ADNOC", "Gazprom", "Rosneft", "Lukoil", "Sberbank", "VTB Bank", "Central Bank of Russia", "SWIFT", "IMF",
    "World Bank",
]
# Malware names: a data file beside this one, which sources.files.load_vocabulary reads as well.
MALWARE_FILE = Path(__file__).with_name("malware.json")
MALWARE = json.loads(MALWARE_FILE.read_text(encoding="utf-8"))["malware"]
#: Labels of the dictionaries, in the order in which entities are listed after the patterns. The last two are empty unless given.
DICTIONARIES = ["MALWARE", "TOOL", "ORG", "COUNTRY", "OPERATION", "INDUSTRY"]


#: Patterns that are plain lists of words: found like dictionaries, in the order of the list.
WORD_LISTS = {label: m[1].split("|") for label, p, cased in PATTERNS if not cased and (m := re.fullmatch(r"\\b\(\?:([^()\[\]\\*+?{}]*)\)\\b", p))}


def normalize_terms(terms: list[str] | None) -> list[str]:
    return [t.strip() for t in terms or [] if t and t.strip()]


def compile_dictionary(terms: list[str] | None) -> str | None:
    """One pattern for all terms in the order of their code points, under a branch for each first letter; None without terms."""
    branches: dict[str, list[str]] = {}
    for t in sorted({re.escape(t) for t in normalize_terms(terms)}):
        head = t[:2] if t[0] == "\\" else t[0]
        branches.setdefault(head.lower(), []).append(t[len(head) :])
    return r"\b(?:" + "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in branches.items()) + r")\b" if branches else None


@dataclass
class Vocabulary:
    """Terms by dictionary. A list given for a label replaces the one built in."""

    malware: list[str] = field(default_factory=lambda: list(MALWARE))
    tool: list[str] = field(default_factory=lambda: list(TOOLS))
    org: list[str] = field(default_factory=lambda: list(ORGANISATIONS))
    country: list[str] = field(default_factory=lambda: list(COUNTRIES))
    operation: list[str] = field(default_factory=list)
    industry: list[str] = field(default_factory=list)

    def terms(self) -> list[tuple[int, int, str]]:
        """(label_rank, place, term) of the word lists and dictionaries. Dictionaries have one place: their order is that of their escaped terms."""
        listed = [(k, n, t) for k, (label, _, _) in enumerate(PATTERNS) for n, t in enumerate(WORD_LISTS.get(label, []))]
        return listed + [(len(PATTERNS) + k, 0, t) for k, label in enumerate(DICTIONARIES) for t in normalize_terms(getattr(self, label.lower()))]

    @staticmethod
    def pattern(rank: int) -> tuple[str, bool]:
        """Java pattern of a fixed pattern, and whether it has a group."""
        _, p, cased = PATTERNS[rank]
        return ("(?U)" if cased else "(?iU)") + p, p.replace(r"\(", "").count("(") > p.count("(?")
