"""Rule list of the 26-state activity chain (K5)."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results): the states in matrix order, and for one or more from-states
# each to-state with its probability. A state without a rule stays where it is.
# ---------------------------------------------------------------------------
STATES = [
    "Open Account", "Deposit Funds", "Make Purchase", "Pay Bills", "Transfer Funds", "Apply for Credit Card", "Apply for Loan",
    "Invest Money", "Review activities", "Failed Login", "Suspicious Login", "Change Password", "Change Email", "Change Phone",
    "Request New Card", "ATM Withdrawal", "Online Purchase", "POS Purchase", "Balance Check", "Request New PIN", "Report Lost Card",
    "Wire Transfer", "Cash Withdrawal", "Invest in Assets", "Max Out Credit", "Withdraw Funds",
]
RULES = """
Open Account > Deposit Funds 0.4, Apply for Credit Card 0.2, Apply for Loan 0.2, Make Purchase 0.2
Deposit Funds > Make Purchase 0.4, Pay Bills 0.3, Invest Money 0.2, Transfer Funds 0.1
Make Purchase > Make Purchase 0.4, POS Purchase 0.3, Online Purchase 0.2, Balance Check 0.1
Pay Bills > Deposit Funds 0.3, Transfer Funds 0.4, Balance Check 0.2, Review activities 0.1
Transfer Funds > Wire Transfer 0.3, Cash Withdrawal 0.2, Deposit Funds 0.2, Balance Check 0.3
Apply for Credit Card > Deposit Funds 0.3, Make Purchase 0.3, Invest Money 0.2, Review activities 0.2
Apply for Loan > Deposit Funds 0.4, Invest Money 0.4, Review activities 0.2
Invest Money > Invest in Assets 0.5, Withdraw Funds 0.3, Review activities 0.2
Review activities > Balance Check 0.4, Make Purchase 0.3, Pay Bills 0.3
Failed Login, Suspicious Login > Change Password 0.5, Review activities 0.3, Request New PIN 0.2
Change Password, Change Email, Change Phone > Review activities 0.5, Balance Check 0.3, Request New PIN 0.2
Request New Card > Make Purchase 0.3, POS Purchase 0.3, Online Purchase 0.3, Balance Check 0.1
ATM Withdrawal > Make Purchase 0.4, POS Purchase 0.3, Balance Check 0.3
Online Purchase, POS Purchase > Make Purchase 0.3, Balance Check 0.3, Review activities 0.2, Deposit Funds 0.2
Balance Check > Make Purchase 0.3, Pay Bills 0.3, Review activities 0.4
Request New PIN > Make Purchase 0.4, POS Purchase 0.3, Online Purchase 0.3
Report Lost Card > Request New Card 0.5, Review activities 0.5
Wire Transfer > Make Purchase 0.3, Invest Money 0.3, Withdraw Funds 0.2, Balance Check 0.2
Cash Withdrawal > Make Purchase 0.4, POS Purchase 0.3, Balance Check 0.3
Invest in Assets > Withdraw Funds 0.4, Invest Money 0.4, Balance Check 0.2
Max Out Credit > Withdraw Funds 0.5, Review activities 0.3, Balance Check 0.2
Withdraw Funds > Make Purchase 0.4, POS Purchase 0.3, Balance Check 0.3
"""


def rule_rows() -> list[tuple[str, str, float]]:
    """(from_state, to_state, weight) of every rule."""
    out = []
    for line in RULES.strip().splitlines():
        left, right = line.split(" > ")
        out += [(frm, *to.rsplit(" ", 1)) for frm in left.split(", ") for to in right.split(", ")]
    return [(frm, to, float(p)) for frm, to, p in out]
