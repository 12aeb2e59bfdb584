"""The canonical machines."""

from __future__ import annotations

from mooreflow.plans.language import Machine, compile_text

# Programs of the canonical machines.
SEQ101 = """
machine seq101 {
  in bit x
  out bit y
  reset = S0
  state S0 { y = 0  when x -> S1  else -> S0 }
  state S1 { y = 0  when x -> S1  else -> S2 }
  state S2 { y = 0  when x -> S3  else -> S0 }
  state S3 { y = 1  when x -> S1  else -> S2 }
}
"""
TRAFFIC = """
machine traffic {
  in bit tick
  out bit[1:0] light
  reset = RED
  state RED    { light = 0  when tick -> GREEN   else -> RED }
  state GREEN  { light = 1  when tick -> YELLOW  else -> GREEN }
  state YELLOW { light = 2  when tick -> RED     else -> YELLOW }
}
"""
HANDSHAKE = """
machine handshake {
  in bit req
  out bit busy
  out bit ack
  reset = IDLE
  state IDLE { busy = 0  ack = 0  when req -> BUSY  else -> IDLE }
  state BUSY { busy = 1  ack = 0  else -> DONE }
  state DONE { busy = 0  ack = 1  when req -> DONE  else -> IDLE }
}
"""
#: Vectors, comparisons, a bit, negation and priority.
GAUGE = """
machine gauge {
  in bit[7:0] level
  in bit alarm
  out bit[1:0] zone
  reset = LOW
  state LOW  { zone = 0  when alarm && level >= 200 -> PANIC  when level > 100 -> HIGH  else -> LOW }
  state HIGH { zone = 1  when !level == 7 && level[0] -> LOW  when level < 50 || alarm -> MID  else -> HIGH }
  state MID  { zone = 2  when (level != 0) && !alarm -> HIGH  else -> LOW }
  state PANIC { zone = 3  when level[7] -> PANIC  else -> LOW }
}
"""
#: seq101 with one transition changed: it does not overlap detections.
SEQ101_PLAIN = SEQ101.replace("machine seq101", "machine seq101_plain").replace("when x -> S1  else -> S2 }\n}", "when x -> S1  else -> S0 }\n}")


def machine(text: str) -> Machine:
    return compile_text(text)
