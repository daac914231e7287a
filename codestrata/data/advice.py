"""Advice and next steps, each with the condition it is given under."""

from __future__ import annotations

#: These texts are the result.
ADVICE = [
    ("high", "High complexity project requires dedicated migration team with senior architect oversight"),
    ("high", "Implement phased migration approach to minimize business disruption and technical risk"),
    ("high", "Establish comprehensive testing strategy before initiating modernization activities"),
    ("mid", "Moderate complexity project suitable for experienced development team"),
    ("mid", "Plan structured migration timeline with 6-10 week implementation window"),
    ("mid", "Implement code quality gates and automated testing during modernization"),
    ("low", "Low complexity project appropriate for standard development practices"),
    ("low", "Excellent candidate for junior developer skill development and mentoring"),
    ("low", "Consider as pilot project for establishing modernization best practices"),
    ("large", "Large codebase requires automated testing and continuous integration before migration"),
    ("large", "Implement code analysis tools and quality metrics tracking throughout modernization"),
    ("ratio", "High method-to-class ratio indicates potential architectural refactoring opportunities"),
    ("security", "Implement security code review process with focus on input validation and authentication"),
    ("performance", "Establish performance baselines and monitoring before optimization activities"),
]

#: These texts are the result.
STEPS = [
    ("HIGH", "URGENT: Schedule executive review meeting within 48 hours"),
    ("HIGH", "Assemble dedicated modernization team with senior architect"),
    ("HIGH", "Conduct detailed technical debt assessment"),
    ("MEDIUM", "Schedule architecture review meeting within 2 weeks"),
    ("MEDIUM", "Assign experienced development team to project"),
    ("MEDIUM", "Create detailed modernization roadmap"),
    ("LOW", "Include in next quarterly planning cycle"),
    ("LOW", "Monitor for increasing complexity trends"),
    ("LOW", "Apply standard development best practices"),
    ("debt", "Implement architectural refactoring program"),
    ("debt", "Establish coding standards and review processes"),
    ("tests", "Establish comprehensive testing strategy"),
    ("tests", "Implement automated testing pipeline"),
]
