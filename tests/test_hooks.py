"""Python functions in shapes: their answers, what they see, and errors."""

import pytest

from graphwright.api import expand, validate
from graphwright.plans.hooks import Hook, to_term
from graphwright.plans.shapes import ConstraintLoadError, ReportableRuntimeError, ValidationFailure

HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <urn:ex:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "
DATA = HEAD + 'ex:a ex:p 1 , 2 ; ex:q "x" . ex:b ex:p 3 . ex:c ex:q "y" , "z" .'
SHAPE = HEAD + 'ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:p ; sh:property [ sh:path ex:p ; sh:js [ a sh:JSConstraint ; sh:jsFunctionName "f" %s ] ] .'
P, Q = "<urn:ex:p>", "<urn:ex:q>"
INTEGER = "http://www.w3.org/2001/XMLSchema#integer"


def keys(found):
    return sorted((r.focus, r.value, *r.messages) for r in found.results.collect())


@pytest.mark.parametrize(
    "answer, want",
    [
        (True, []), (None, []), ([], []), ([True, None], []),
        (False, [("1", "from the shape")]), ("bad", [("1", "bad")]), (["bad", {"message": "worse", "value": "<urn:ex:x>"}], [("1", "bad"), ("<urn:ex:x>", "worse")]),
        ({"value": 5}, [("5", "from the shape")]),
    ],
)
def test_answers(spark, answer, want):
    hook = Hook(lambda this, value, seen: answer if value.startswith('"1"') else True)
    found = validate(spark, DATA, SHAPE % '; sh:message "from the shape"', hooks={"f": hook})
    term = lambda x: x if x.startswith("<") else f'"{x}"^^<{INTEGER}>'
    assert keys(found) == sorted(("<urn:ex:a>", term(v), m) for v, m in want) and found.conforms == (not want)


def test_a_function_sees_the_triples_of_its_predicates(spark):
    hook = Hook(lambda this, value, seen: seen == {this: {Q: [f'"x"^^<{INTEGER[:-7]}string>']}, value: {}} or str(seen), (Q,))
    assert [r[0] for r in keys(validate(spark, DATA, SHAPE % "", hooks={"f": hook}))] == ["<urn:ex:b>"]


def test_more_triples_than_a_function_takes_are_an_error(spark):
    with pytest.raises(ValidationFailure, match="2 triples"):
        validate(spark, DATA, SHAPE % "", hooks={"f": Hook(lambda this, value, seen: True, (P,), most=1)}).conforms


def test_names_without_a_hook(spark):
    with pytest.raises(ReportableRuntimeError, match="asks for the function f"):
        validate(spark, DATA, SHAPE % "").conforms
    with pytest.raises(ConstraintLoadError):
        validate(spark, DATA, SHAPE.replace('; sh:jsFunctionName "f"', "") % "", hooks={}).conforms
    assert validate(spark, DATA, SHAPE % "; sh:deactivated true").conforms


def test_severity_of_constraints_and_of_components(spark):
    shape = SHAPE.replace("sh:path ex:p ;", "sh:path ex:p ; sh:severity sh:Info ;") % ""
    found = validate(spark, DATA, shape, allow_infos=True, hooks={"f": Hook(lambda this, value, seen: False)})
    assert found.conforms and found.results.count() == 3


def test_targets(spark):
    shape = HEAD + 'ex:S a sh:NodeShape ; sh:target [ a sh:JSTarget ; sh:jsFunctionName "t" ] ; sh:property [ sh:path ex:p ; sh:minCount 1 ] .'
    found = validate(spark, DATA, shape, advanced=True, hooks={"t": Hook(lambda this, seen: len(seen[this][Q]) == 2, (Q,))})
    assert [r.focus for r in found.results.collect()] == ["<urn:ex:c>"]
    with pytest.raises(ConstraintLoadError):
        validate(spark, DATA, shape, advanced=True, hooks={"t": Hook(lambda this, seen: True)}).conforms


def test_rules_until_nothing_is_added(spark):
    shape = HEAD + 'ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:p ; sh:rule [ a sh:JSRule ; sh:jsFunctionName "r" ] .'
    number = lambda x: int(x.split('"')[1])
    hook = Hook(lambda this, seen: [(this, P, number(x) + 1) for x in seen[this][P] if number(x) < 5], (P,))
    once, often = (expand(spark, DATA, shape, iterate_rules=again, hooks={"r": hook}) for again in (False, True))
    assert [x.where(f"p = '{P}'").count() for x in (once, often)] == [5, 8]  # a: 1 2 3, b: 3 4; then a: 1 to 5, b: 3 to 5


def test_an_empty_graph(spark):
    assert validate(spark, HEAD + "ex:z ex:z ex:z .", SHAPE % "", hooks={"f": Hook(lambda this, value, seen: False, (P,))}).conforms


def test_terms_of_answers():
    assert [to_term(x) for x in (None, True, 1, "a", "<a>", "_:b", '"a"@en')] == [None, f'"true"^^<{INTEGER[:-7]}boolean>', f'"1"^^<{INTEGER}>', f'"a"^^<{INTEGER[:-7]}string>', "<a>", "_:b", '"a"@en']
    with pytest.raises(TypeError):
        to_term([1])
