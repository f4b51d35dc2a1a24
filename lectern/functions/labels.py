"""What a form's labels stand for."""

from __future__ import annotations

# Labels of choices.
FORMATS = {"Default": "default", "Default Excel": "default", "Standard Assessment": "standard"}
MODES = {"Auto": "auto", "Prose": "prose", "Tables": "tables", "Standard / Structured": "standard", "NIST 800-53": "nist80053"}
PROFILES = {
    "Auto": "auto", "Auto-detect": "auto", "Generic": "generic", "NIST 800-53": "nist80053", "Control Catalog": "control-catalog", "Control catalog": "control-catalog",
    "ISO-like": "iso", "Legal / Article": "legal", "Legal/article": "legal", "PCI": "pci", "PCI DSS": "pci", "CIS": "cis", "CIS Controls": "cis",
}
OCR = {"Off": "off", "Detect only": "detect", "off": "off", "detect": "detect"}
RENDER = {"Auto": "auto", "Always": "always", "Never": "never"}


def choice(label: str | None, choices: dict[str, str], default: str) -> str:
    """The value of a label, whatever its case; some words are enough for the two formats."""
    said = (label or "").strip()
    low = said.lower()
    known = {k.lower(): v for k, v in reversed(choices.items())}
    if said in choices or low in known:
        return choices.get(said, known.get(low))
    if "standard assessment" in low or low == "standard":
        return "standard"
    return "default" if "default" in low else default
