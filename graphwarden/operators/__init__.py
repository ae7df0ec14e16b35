"""Set-based operators: rules, closure, findings, repair."""
