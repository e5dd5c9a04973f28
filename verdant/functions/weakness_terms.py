"""Fixed values of the layered label verdict; every operator takes them as parameters."""

# Labels that name one id whatever the alias table says.
SAFE_EQUIVALENT_ALIASES = {
    "integer overflow": "CWE-190",
    "heap buffer overflow": "CWE-122",
    "heap based buffer overflow": "CWE-122",
    "stack buffer overflow": "CWE-121",
    "stack based buffer overflow": "CWE-121",
    "cross site request forgery": "CWE-352",
    "unsafe deserialization": "CWE-502",
    "insecure deserialization": "CWE-502",
    "timing side channel": "CWE-208",
    "template injection": "CWE-1336",
    "toctou race condition": "CWE-367",
    "time of check time of use toctou": "CWE-367",
    "time of check to time of use toctou": "CWE-367",
    "missing authentication": "CWE-306",
    "use after free": "CWE-416",
}

# Labels that name an effect, not a weakness.
CONSEQUENCE_TERMS = [
    "denial of service", "dos", "remote code execution", "rce", "arbitrary code execution", "code execution",
    "unauthorized code execution", "privilege escalation", "local privilege escalation", "information disclosure",
    "information exposure", "information leak", "sensitive data exposure", "sensitive information exposure",
    "credential exposure", "data exposure", "application crash", "crash", "memory corruption",
    "arbitrary file read", "arbitrary file write",
]

# Broad labels and the ids that they may mean.
EXTRA_BROAD_TERMS = {
    "authentication bypass": ["CWE-288", "CWE-289", "CWE-294", "CWE-305", "CWE-306"],
    "authorization bypass": ["CWE-284", "CWE-285", "CWE-639", "CWE-862", "CWE-863", "CWE-939"],
    "security feature bypass": ["CWE-288", "CWE-289", "CWE-305", "CWE-693"],
    "path traversal": ["CWE-22", "CWE-23", "CWE-35", "CWE-36"],
    "race condition": ["CWE-362", "CWE-364", "CWE-367"],
    "resource leak": ["CWE-401", "CWE-404", "CWE-772"],
    "out of bounds access": ["CWE-125", "CWE-126", "CWE-787"],
    "out of bounds memory access": ["CWE-125", "CWE-126", "CWE-787"],
    "out of bounds read write": ["CWE-125", "CWE-787"],
    "improper input validation": ["CWE-20", "CWE-129", "CWE-130", "CWE-1284", "CWE-1287"],
    "insufficient input validation": ["CWE-20", "CWE-129", "CWE-130", "CWE-1284", "CWE-1287"],
    "improper validation": ["CWE-20", "CWE-129", "CWE-130", "CWE-1284", "CWE-1287"],
    "insufficient validation": ["CWE-20", "CWE-129", "CWE-130", "CWE-1284", "CWE-1287"],
}
